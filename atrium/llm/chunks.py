"""Encoding whole texts chunk by chunk, with a bounded memory of chunks seen before.

Byte-level pre-splitting never joins a character with the white space after it, so a text without
two white-space characters in a row can be cut before each space and around each line feed, and each chunk
encoded alone.  Any other text, and any text with characters outside Latin-1 (where Unicode
versions of two libraries may differ), is encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable

#: Two white-space characters in a row, where only spaces and line feeds occur.
_DOUBLE = ("  ", "\n\n", " \n", "\n ")


def printable(text: str) -> bool:
    """Whether all characters are printable ones of Latin-1."""
    if not text.isprintable():
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def has_double(text: str) -> bool:
    """Whether two white-space characters stand in a row."""
    return any(pair in text for pair in _DOUBLE)


class Memory(dict):
    """chunk -> encoded bytes, in two generations: the older one goes when the newer has ``most`` entries.

    A chunk that is met again while it is in the older one moves to the newer one, so common chunks stay.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, chunk: str) -> bytes:
        value = self.older.get(chunk)
        if value is None:
            value = self.encode(chunk)
            if len(chunk) > 40:
                return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[chunk] = value
        return value


class SpacedEncoder:
    """``encode`` gives the bytes of one chunk; ``whole`` those of any text; ``spaced`` those of a chunk and the space before it.

    The memories hold ``most`` chunks in each generation, about 150 bytes for each.
    """

    def __init__(self, encode: Callable[[str], bytes], whole: Callable[[str], bytes], most: int = 600_000, spaced: Callable[[str], bytes] | None = None) -> None:
        self.bare = Memory(encode, most // 8)
        self.spaced = Memory(spaced or (lambda c: encode(" " + c)), most)
        self.whole = whole
        self.feed: bytes | None = None

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if has_double(text) or not printable(text.replace("\n", "")):
            return self.whole(text)
        if self.feed is None:
            self.feed = self.bare["\n"]
        bare, spaced, out = self.bare, self.spaced, []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(self.feed)
            first, *rest = line.split(" ")
            if first:
                out.append(bare[first])
            out.extend(map(spaced.__getitem__, rest))
        return b"".join(out)
