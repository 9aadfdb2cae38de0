"""Byte-level BPE as a finite-state transducer that is made deterministic on demand.

A rank file fixes which pairs of neighbouring tokens can stand beside each other: (a, b) is
*stable* if merging the bytes of a+b by rank ends in exactly [a, b].  A sequence of tokens is the
encoding of its bytes if and only if every neighbouring pair is stable, because the first merge
across a border would also happen when the two tokens stand alone.  So the non-deterministic
transducer has a thread for each (last token, place in the token trie); a thread ends a token only
if it is stable after its last one, and after each byte exactly one thread has just ended a token.

The deterministic machine is the subset construction: a state is the set of live threads, and a move
by one byte gives the next state and the token that has just ended.  Each position has one such token, so every
thread has one way back to the start; up to the last position that all their ways share, the encoding is certain, and
those tokens leave.  ``Stream`` emits them after each piece of bytes that it is fed and keeps only what is still open.
States and moves are made when a text first needs them, and are dropped together when there are too many.
"""

from __future__ import annotations

from atrium.llm.utf8 import TokenStream


class _State(dict):
    """byte -> (token that ends with it, next state)."""

    __slots__ = ("machine", "threads")

    def __init__(self, machine: Transducer, threads: tuple[int, ...]) -> None:
        super().__init__()
        self.machine, self.threads = machine, threads

    def __missing__(self, byte: int) -> tuple[int, _State]:
        made = self[byte] = self.machine._move(self.threads, byte)
        return made


class Stream:
    """Bytes arrive in pieces of any size, ids leave as soon as all live threads agree on them."""

    def __init__(self, machine: Transducer) -> None:
        self.machine = machine
        self.state = machine.start
        #: The token that ends at each position after what has left.
        self.ended: list[int] = []

    def _back(self, to: int) -> list[int]:
        """The tokens from the last emission up to position ``to``."""
        ids, size, ended = [], self.machine.size_of, self.ended
        while to:
            token = ended[to - 1]
            ids.append(token)
            to -= size[token]
        ids.reverse()
        return ids

    def feed(self, piece: bytes) -> list[int]:
        state, put = self.state, self.ended.append
        for byte in piece:
            token, state = state[byte]
            put(token)
        self.state = state
        machine, ended = self.machine, self.ended
        starts = {len(ended) - machine.depth[thread & 0xFFFFFFFF] for thread in state.threads}
        while len(starts) > 1:
            last = max(starts)
            starts.remove(last)
            starts.add(last - machine.size_of[ended[last - 1]])
        (certain,) = starts
        ids = self._back(certain)
        del ended[:certain]
        if machine.made > machine.most_moves:
            machine.reset()
            self.state = machine.state(state.threads)
        return ids

    def close(self) -> list[int]:
        ids = self._back(len(self.ended))
        self.state, self.ended = self.machine.start, []
        return ids


class Transducer:
    """``ranks``: token bytes -> rank, which is also the id.  ``most_moves`` bounds what is kept."""

    def __init__(self, ranks: dict[bytes, int], most_moves: int = 300_000) -> None:
        self.ranks = ranks
        self.most_moves = most_moves
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size_of = {i: len(b) for b, i in ranks.items()}
        #: The token trie: the children of each node (none: a thread ends there), the token that ends there, and the depth.
        self.child: list[dict[int, int]] = [{}]
        self.ends, self.depth = [-1], [0]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                after = self.child[node].get(byte)
                if after is None:
                    after = self.child[node][byte] = len(self.ends)
                    self.child.append({})
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = after
            self.ends[node] = i
        self.text = TokenStream(self.bytes_of)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.pair_ok: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forgets all states and moves.  A thread is (last token + 1) << 32 | trie node."""
        self.known: dict[tuple[int, ...], _State] = {}
        self.made = 0
        self.start = self.state((0,))

    def state(self, threads: tuple[int, ...]) -> _State:
        found = self.known.get(threads)
        if found is None:
            found = self.known[threads] = _State(self, threads)
        return found

    def merged(self, data: bytes, to: int = 1) -> list[bytes]:
        """The plain rule: merge the pair of lowest rank, leftmost first, until none or ``to`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > to:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that ``token`` is merged from at last: itself twice for a byte, None if it never arises."""
        if token not in self.parts:
            data = self.bytes_of[token]
            two = self.merged(data, 2)
            if len(data) == 1:
                self.parts[token] = (token, token)
            elif len(two) == 2 and all(x in self.ranks for x in two):
                self.parts[token] = (self.ranks[two[0]], self.ranks[two[1]])
            else:
                self.parts[token] = None
        return self.parts[token]

    def _undone(self, a: int, b: int) -> bool:
        """Whether [a, b] stays, found by undoing the merges of both from the last to the first.

        Before each undone merge the two tokens at the border must not have had a merge of lower rank (of
        equal rank, if the undone one lies to its right).  Holds where a token's rank exceeds its parts'.
        """
        lowest = float("inf")
        bytes_of, rank, parts = self.bytes_of, self.ranks.get, self._split
        while True:
            joint = rank(bytes_of[a] + bytes_of[b])
            if joint is not None and joint < lowest:
                return False
            left, right = parts(a), parts(b)
            if left is None or right is None or max(left) > a or max(right) > b:
                return self.merged(bytes_of[a] + bytes_of[b]) == [bytes_of[a], bytes_of[b]]
            whole_a, whole_b = left[0] == a, right[0] == b
            if whole_a and whole_b:
                return True
            if whole_b or not whole_a and a > b:
                lowest, a = a, left[1]
            else:
                lowest, b = b + 1, right[0]

    def _stable(self, last: int, token: int) -> bool:
        if self._split(token) is None:
            known = False
        else:
            known = last < 0 or self._undone(last, token)
        if len(self.pair_ok) > 3 * self.most_moves:
            self.pair_ok.clear()
        self.pair_ok[last << 32 | token] = known
        return known

    def _move(self, live: tuple[int, ...], byte: int) -> tuple[int, _State]:
        threads: list[int] = []
        ended = -1
        children, ends, pair_ok = self.child, self.ends, self.pair_ok.get
        for thread in live:
            child = children[thread & 0xFFFFFFFF].get(byte)
            if child is None:
                continue
            token = ends[child]
            if token >= 0 and ended < 0:
                last = (thread >> 32) - 1
                ok = pair_ok(last << 32 | token)
                if self._stable(last, token) if ok is None else ok:
                    ended = token
            if children[child]:
                threads.append(thread & ~0xFFFFFFFF | child)
        if ended < 0:
            raise ValueError("the vocabulary has no token for a byte")
        threads.append(ended + 1 << 32)
        self.made += 1
        return ended, self.state(tuple(threads))

    def encode(self, piece: bytes, at_once: int = 4096) -> list[int]:
        """The ids of one pre-split piece.  A long one is fed in parts, so that only what is open is held."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > at_once:
            stream, ids = Stream(self), []
            for i in range(0, len(piece), at_once):
                ids += stream.feed(piece[i : i + at_once])
            return ids + stream.close()
        if self.made > self.most_moves:
            self.reset()
        ended, state = [], self.start
        put = ended.append
        for byte in piece:
            token, state = state[byte]
            put(token)
        ids = []
        at, size = len(ended), self.size_of
        while at:
            token = ended[at - 1]
            ids.append(token)
            at -= size[token]
        ids.reverse()
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, by the UTF-8 state machine over tokens."""
        return self.text.decode(ids)
