"""Operator 12: BPE encoding by speculation and verification, and decoding.

For each word the longest token that fits is taken again and again: a proposal.  It is the BPE encoding if no merge
across any of its cuts would have come before the merges that made the tokens on both sides; that is a property of two
adjacent tokens alone, and is tested for all distinct pairs of a batch at once in numpy, by taking both tokens apart
from the last merge to the first.  Only words with a failing pair undergo exact merging.

A cut between x and y fails if (x, y) merges before x is taken into the token on its left and not after y is
taken into the one on its right: of merges of one rank the leftmost comes first.  Tokens that exact merging of their own letters would not give
are never proposed; the same test finds them.  Rests on merges whose parts are made by earlier ones, which is checked on loading.

Words come from the file's own normaliser and split.  For texts of printable Latin-1 signs, tabs and line ends these are
lower-casing and one pattern, applied to chunks between white space that are seen again and again; other texts go through
the tokenizer file's normaliser and split as a whole, and their words through the same proposals.  Strings of special tokens are
cut out of the text first and get their ids.

Defined cases: null text counts as empty and gives no tokens; every row gives one row, repeated rows too; an empty table gives
none; nothing is shuffled.  Texts and words may have any length (a task holds the tokens of one batch; exact merging takes n log n steps);
only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atrium.llm.chunks import printable
from atrium.llm.common import short_batches
from atrium.llm.library_tokens import byte_letters, read_tokenizer
from atrium.llm.remembered import LONGEST, Remembered

NEVER = np.int64(1) << 40
_MADE: dict[str, Words] = {}


class Merges:
    """The merges of a vocabulary as arrays over token ids, with the test of adjacent tokens."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.suffix, size = suffix, max(vocab.values()) + 1
        self.vocab = vocab
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.result = [vocab[a + b] if not a.endswith(suffix) or not suffix else -1 for a, b in merges]
        self.born = np.full(size, -1, "int64")
        self.left, self.right = np.arange(size), np.arange(size)
        for (a, b), r in self.rank.items():
            made = self.result[r]
            if made < 0 or self.born[made] >= 0:
                raise ValueError("merges must make each token once, from tokens of earlier merges")
            self.born[made], self.left[made], self.right[made] = r, a, b
        if any(max(self.born[a], self.born[b]) >= r for (a, b), r in self.rank.items()):
            raise ValueError("merges must make each token once, from tokens of earlier merges")
        pairs = np.array([a * size + b for a, b in self.rank] or [0], "int64")
        order = np.argsort(pairs)
        self.size, self.pairs, self.pair_rank = size, pairs[order], np.arange(len(pairs), dtype="int64")[order]
        if not self.rank:
            self.pair_rank = np.array([NEVER])
        # a token is proposed if its letters alone give it: both parts do, and nothing crosses their cut before its own merge
        made = np.flatnonzero(self.born >= 0)
        whole = np.ones(size, bool)
        whole[made] = self.compatible(self.left[made], self.right[made], self.born[made])
        for r in range(len(merges)):
            t = self.result[r]
            whole[t] &= whole[self.left[t]] & whole[self.right[t]]
        proposed = [(s, i) for s, i in vocab.items() if whole[i]]
        cut = len(suffix)
        self.last = {s[:-cut] if cut else s: i for s, i in proposed if s.endswith(suffix)}
        self.inner = {s: i for s, i in proposed if not (cut and s.endswith(suffix))}
        # every prefix of a token -> the longest token that it starts with
        self.starts: dict[str, tuple[int, int]] = {}
        for token in sorted(self.inner, key=len):
            for k in range(1, len(token)):
                start = token[:k]
                if start not in self.starts:
                    self.starts[start] = self.starts.get(start[:-1], (-1, 0))
            self.starts[token] = (self.inner[token], len(token))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair; NEVER if there is none."""
        asked = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
        return np.where(self.pairs[at] == asked, self.pair_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | np.int64 = NEVER) -> np.ndarray:
        """Whether no merge crosses the cut between the tokens of each pair before the rank ``until``."""
        good, at = np.ones(len(a), bool), np.arange(len(a))
        x, y = np.asarray(a, "int64"), np.asarray(b, "int64")
        x_goes = y_goes = np.broadcast_to(until, len(x)).astype("int64")
        while len(at):
            rank = self.ranks(x, y)
            crossed = (rank < x_goes) & (rank <= y_goes) & (rank < NEVER)
            good[at[crossed]] = False
            x_born, y_born = self.born[x], self.born[y]
            on = ~crossed & ((x_born >= 0) | (y_born >= 0))
            x_last = x_born > y_born  # the younger one is taken apart; of one age, the right one
            x_goes, y_goes = np.where(x_last, x_born, x_goes)[on], np.where(x_last, y_goes, y_born)[on]
            x, y, at = np.where(x_last, self.right[x], x)[on], np.where(x_last, y, self.left[y])[on], at[on]
        return good

    def propose(self, word: str) -> list[int] | None:
        """The longest tokens that fit, from the left; None where none fits."""
        last, starts, out, at, n = self.last, self.starts.get, [], 0, len(word)
        while True:
            if n - at <= 256 and (whole := last.get(word[at:])) is not None:
                out.append(whole)
                return out
            found, k = starts(word[at : at + 1]), 2
            while at + k < n and (longer := starts(word[at : at + k])) is not None:
                found, k = longer, k + 1
            if found is None or found[0] < 0 or at + found[1] >= n:
                return None
            out.append(found[0])
            at += found[1]

    def exact(self, words: list[str]) -> list[list[int]]:
        """The merges one by one, in all words at once: always the one of lowest rank, the leftmost of several."""
        spelled = [[*map(self.vocab.__getitem__, w[:-1]), self.vocab[w[-1] + self.suffix]] for w in words]
        found = [self._merged_long(ids) if len(ids) > LONGEST else ids for ids in spelled]
        word = np.array([i for i, ids in enumerate(spelled) if 1 < len(ids) <= LONGEST], "int64")
        counts = np.array([len(found[i]) for i in word], "int64")
        ids = np.fromiter((t for i in word for t in found[i]), "int64", int(counts.sum()))
        result, ends = np.array(self.result + [-1], "int64"), np.cumsum(counts)
        ranks = np.full(len(ids), NEVER)
        ranks[:-1] = self.ranks(ids[:-1], ids[1:])
        ranks[ends - 1] = NEVER
        while len(word):
            starts = ends - counts
            least = np.minimum.reduceat(ranks, starts)
            on = least < NEVER
            if not on.all():  # words without an open pair are done
                for w, low, high in zip(word[~on].tolist(), starts[~on].tolist(), ends[~on].tolist(), strict=True):
                    found[w] = ids[low:high].tolist()
                stay = np.repeat(on, counts)
                word, counts, least, ids, ranks = word[on], counts[on], least[on], ids[stay], ranks[stay]
                ends = np.cumsum(counts)
                if not len(word):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, counts))
            at = at[np.unique(np.searchsorted(ends, at, side="right"), return_index=True)[1]]
            ids[at] = result[least]
            left = np.ones(len(ids), bool)
            left[at + 1] = False
            last = at + 2 == ends  # the pair was its word's last
            ids, ranks, counts = ids[left], ranks[left], counts - 1
            ends = np.cumsum(counts)
            at -= np.arange(len(at))
            ranks[at] = np.where(last, NEVER, self.ranks(ids[at], ids[np.minimum(at + 1, len(ids) - 1)]))
            inside = at[at > ends - counts] - 1
            ranks[inside] = self.ranks(ids[inside], ids[inside + 1])
        return found

    def _merged_long(self, ids: list[int]) -> list[int]:
        """With a heap of the open pairs, so that a long word takes n log n steps."""
        n, rank = len(ids), self.rank
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        open_pairs = [(rank[p], i) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in rank]
        heapq.heapify(open_pairs)
        while open_pairs:
            r, i = heapq.heappop(open_pairs)
            j = following[i]
            if ids[i] < 0 or j >= n or rank.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = self.result[r], -1
            following[i] = k = following[j]
            if k < n:
                before[k] = i
                if (ids[i], ids[k]) in rank:
                    heapq.heappush(open_pairs, (rank[ids[i], ids[k]], i))
            h = before[i]
            if h >= 0 and (ids[h], ids[i]) in rank:
                heapq.heappush(open_pairs, (rank[ids[h], ids[i]], h))
        return [i for i in ids if i >= 0]

    def encode(self, words: list[str]) -> tuple[list[list[int]], int]:
        """The ids of each (non-empty) word, and how many words were merged exactly."""
        found = [self.propose(w) for w in words]
        exact = {i for i, f in enumerate(found) if f is None}
        counts = np.array([len(f) if f else 0 for f in found], "int64")
        flat = np.fromiter((t for f in found if f for t in f), "int64", int(counts.sum()))
        word = np.repeat(np.arange(len(words)), counts)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        exact.update(word[inside[~good[which]]].tolist())
        for i, ids in zip(exact, self.exact([words[i] for i in exact]), strict=True):
            found[i] = ids
        return found, len(exact)


class Words:
    """A tokenizer file of lower-cased words: normaliser, split, byte letters, merges with a word-end sign, no decoder."""

    def __init__(self, json_file: bytes, most: int = 200_000) -> None:
        from tokenizers import Tokenizer

        parts = json.loads(json_file)
        model = parts["model"]
        if parts["decoder"] is not None or model["type"] != "BPE" or not model["end_of_word_suffix"]:
            raise ValueError("this operator is for BPE of words with an end sign, without a decoder")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in parts["added_tokens"]):
            raise ValueError("added tokens must be taken from the text as they stand")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.first_sign = {t[:2] for t in self.special}
        names = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.library = Tokenizer.from_str(json_file.decode())
        self.split = regex.compile(parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.words, self.chunks = Remembered(most), Remembered(most)
        self.exact = self.proposed = 0

    def _encode(self, words: set[str]) -> None:
        """Puts the words (in byte letters) into the memory."""
        new = self.words.pending(words)
        found, exact = self.merges.encode(new)
        self.proposed, self.exact = self.proposed + len(new), self.exact + exact
        self.words.update((w, array("I", f).tobytes()) for w, f in zip(new, found, strict=True))

    def _spelled(self, word: str) -> str:
        return word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native 32-bit bytes."""
        plain = [printable(t.replace("\n", "").replace("\t", "").replace("\r", "")) and not any(s in t for s in self.first_sign) for t in texts]
        split = [t.split() if p else None for t, p in zip(texts, plain, strict=True)]
        new = self.chunks.pending(set().union(*filter(None, split)))
        pieces = [[self._spelled(low)] if (low := c.lower()).isalpha() else list(map(self._spelled, self.split.findall(low))) for c in new]
        others = {i: self._any(t) for i, (t, p) in enumerate(zip(texts, plain, strict=True)) if not p}
        self._encode(set().union(*pieces, *([w for w in o if isinstance(w, str)] for o in others.values())))
        of = self.words.__getitem__
        self.chunks.update((c, of(p[0]) if len(p) == 1 else b"".join(map(of, p))) for c, p in zip(new, pieces, strict=True))
        of_chunk = self.chunks.__getitem__
        return [b"".join(map(of_chunk, split[i])) if plain[i] else b"".join(of(w) if isinstance(w, str) else array("I", [w]).tobytes() for w in others[i]) for i in range(len(texts))]

    def _any(self, text: str) -> list[str | int]:
        """The words (in byte letters) of any text, and the ids of special tokens between them."""
        out: list[str | int] = []
        at = 0
        for m in self.cut_special.finditer(text):
            out += self._words(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        text = text.encode("utf-8", "replace").decode()
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))] if text else []

    def decode(self, ids: Iterable[int]) -> str:
        """The library's text of ids where a file names no decoder: the tokens' names with a space between them."""
        return " ".join(map(self.names.__getitem__, ids))


def words_of(json_file: bytes) -> Words:
    """One for each process."""
    key = hashlib.md5(json_file).hexdigest()
    if key not in _MADE:
        _MADE[key] = Words(json_file)
    return _MADE[key]


def encode_column(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encodes ``text_col`` and decodes the ids again.

    Returns ``id_col``, ``n_tokens`` and ``ids`` (array of int) and ``decoded`` (text); with ``digests``
    the two last give way to ``ids_sha256`` (of the ids as little-endian 32-bit numbers) and ``decoded_sha256``.
    """
    spark = df.sparkSession
    short_batches(spark)
    json_file = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))  # a vocabulary file: a fixed size, under two megabytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words_of(json_file.value)
        for batch in batches:
            data = coder.encode([t or "" for t in batch.column(1).to_pylist()])
            numbers = [memoryview(d).cast("I") for d in data]
            texts = map(coder.decode, numbers)
            if digests:
                arrays = [pa.array([hashlib.sha256(np.frombuffer(d, "uint32").astype("<u4", copy=False)).hexdigest() for d in data], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]
            else:
                arrays = [pa.array([n.tolist() for n in numbers], pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(n) for n in numbers], pa.int64()), *arrays], names=names)

    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = [df.schema[id_col].dataType, T.LongType(), *([T.StringType(), T.StringType()] if digests else [T.ArrayType(T.IntegerType()), T.StringType()])]
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(names, kinds, strict=True)])
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)
