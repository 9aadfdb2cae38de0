"""An incremental UTF-8 state machine, over bytes and lifted to tokens."""

from __future__ import annotations

from collections.abc import Iterable

BAD = "�"


def _after(held: bytes) -> tuple[int, int, int]:
    """Continuation bytes that are due after the valid beginning ``held`` of a character, and the range of the next."""
    lead = held[0]
    need = 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3
    if len(held) > 1:
        return need - len(held) + 1, 0x80, 0xBF
    return need, {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80), {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)


def step(held: bytes, byte: int) -> tuple[str, bytes]:
    """One move: the text that becomes certain with ``byte``, and the beginning of a character that is left.

    A broken character gives U+FFFD for its longest valid beginning, as the standard recommends.
    """
    if held:
        due, low, high = _after(held)
        if low <= byte <= high:
            whole = held + bytes([byte])
            if due > 1:
                return "", whole
            code = whole[0] & (0xFF >> len(whole) + 1)
            for b in whole[1:]:
                code = code << 6 | b & 0x3F
            return chr(code), b""
        text, held = step(b"", byte)
        return BAD + text, held
    if byte < 0x80:
        return chr(byte), b""
    return ("", bytes([byte])) if 0xC2 <= byte <= 0xF4 else (BAD, b"")


class Utf8Stream:
    """Bytes arrive in pieces; text leaves as soon as it is certain.  Three bytes at most are held."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, piece: bytes) -> str:
        out, held = [], self.held
        for byte in piece:
            text, held = step(held, byte)
            out.append(text)
        self.held = held
        return "".join(out)

    def close(self) -> str:
        rest, self.held = BAD if self.held else "", b""
        return rest


class _Held(dict):
    """The state with ``held`` bytes: token -> (text, next state), each worked out when first met."""

    def __init__(self, machine: TokenStream, held: bytes) -> None:
        super().__init__()
        self.machine, self.held = machine, held

    def __missing__(self, token: int) -> tuple[str, _Held]:
        stream = Utf8Stream()
        stream.held = self.held
        text = stream.feed(self.machine.bytes_of[token])
        made = self[token] = text, self.machine.state(stream.held)
        return made


class _Whole(dict):
    """Token -> its text if it leads from the state without held bytes back to it, else None."""

    def __init__(self, start: _Held) -> None:
        super().__init__()
        self.start = start

    def __missing__(self, token: int) -> str | None:
        text, after = self.start[token]
        made = self[token] = None if after.held else text
        return made


class TokenStream:
    """The machine with a whole token as one move.  Moves are kept: as many as tokens in most states, for few states."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.bytes_of = bytes_of
        self.states: dict[bytes, _Held] = {}
        self.whole = _Whole(self.state(b""))

    def state(self, held: bytes) -> _Held:
        if held not in self.states:
            self.states[held] = _Held(self, held)
        return self.states[held]

    def decode(self, ids: Iterable[int], at_once: int = 8192) -> str:
        """The text of ``ids``.  Blocks of tokens that all keep to the first state are joined at once."""
        ids = list(ids)
        first = state = self.state(b"")
        out: list[str] = []
        for i in range(0, len(ids), at_once):
            block = ids[i : i + at_once]
            if state is first:
                texts = list(map(self.whole.__getitem__, block))
                if None not in texts:
                    out += texts
                    continue
            for token in block:
                text, state = state[token]
                out.append(text)
        if state.held:
            out.append(BAD)
        return "".join(out)
