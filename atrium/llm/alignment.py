"""Operator 13: which tokens of two tokenizers cover the same bytes, and how often over the corpus.

Side A is byte-level BPE of a space and the text, side B a piece model, which puts that space there itself, so the
tokens of both cut one byte string.  In each batch ``pandas.merge_asof``, keyed by document, finds for every token start of
one side the token of the other side that covers it: A's starts in B and B's starts in A together are all overlapping pairs (a
common start is taken from the first alone).  Places where tokens of both sides end cut the tokens into groups.

Counts of id pairs over the corpus need two passes.  The first keeps each document's distinct pairs with their numbers and adds
up a task's pairs before they are shuffled.  In the second, the pairs that make up at least one of ``MOST_COMMON`` of all
links (there are at most so many) go to the tasks as sorted arrays; only rarer pairs are joined by a shuffle, and
none of them has more than that share, so there is no hot key.

Defined cases: a null or empty text, or one whose joined tokens of a side are not a space and the text, has no tokens: zeros and an empty
digest; every row gives one row, repeated rows too (their links count again); an empty table gives none; ties for a B id's
highest count are all highest; texts may have any length (a task holds one batch, cut where it exceeds ``BATCH_BYTES``); only the id and
the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atrium.llm.chunks import has_double, printable
from atrium.llm.common import kept, short_batches
from atrium.llm.library_tokens import STOPS, byte_letters, read_tokenizer
from atrium.llm.remembered import Remembered

#: Pairs with more than one link in so many are looked up in tasks; so many at most.
MOST_COMMON = 1 << 19
#: Bytes of texts that are aligned at once.
BATCH_BYTES = 1 << 22
#: Distinct pairs of a task that are added up before they are sent.
HELD_PAIRS = 1 << 21
#: A pair is a * SHIFT + b.
SHIFT = 1 << 20
_MADE: dict[str, Sides] = {}


class Sides:
    """Both tokenizers: ids of texts, and the bytes of ids."""

    def __init__(self, a_file: bytes, b_file: bytes, most: int = 200_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_file.decode()), sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.letters, self.tokenize = byte_letters(), self.a.model.tokenize
        of = {letter: byte for byte, letter in enumerate(self.letters)}
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(of[c] for c in names[i]) if i in names and all(c in of for c in names[i]) else b"" for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], "int64") for side in (self.a_bytes, self.b_bytes))
        # no piece goes on after a space or holds a line feed, so no token of B crosses a chunk's border
        self.by_chunk = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.space, self.feed = self.b.piece_to_id("▁"), self.b.encode("\n")[1:]
        self.spaced, self.bare = Remembered(most), Remembered(most // 8)
        separated = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        #: ids with what stands behind them in the text of groups: number ``k * size + id`` has sign k
        self.decimals, self.size = [d + sign for sign in (",", "|", ";", "") for d in separated], len(separated)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(A's ids of a space and the text, B's ids of the text) as native 32-bit bytes."""
        plain = [self.by_chunk and not has_double(" " + t) and printable(t.replace("\n", "")) for t in texts]
        lines = [[line.split(" ") for line in (" " + t).split("\n")] if p else [] for t, p in zip(texts, plain, strict=True)]
        self._learn(self.spaced, set(itertools.chain.from_iterable(line[1:] for text in lines for line in text)), True)
        self._learn(self.bare, {line[0] for text in lines for line in text if line[0]} | {"\n"}, False)
        spaced, bare, feed = self.spaced.__getitem__, self.bare, self.bare["\n"]
        out = []
        for text, cut in zip(texts, lines, strict=True):
            if not cut:
                out.append((self._packed(self.a.encode(" " + text, add_special_tokens=False).ids), self._packed(self.b.encode(text))))
                continue
            parts = list(map(spaced, cut[0][1:]))
            for line in cut[1:]:
                parts.append(feed)
                if line[0]:
                    parts.append(bare[line[0]])
                parts.extend(map(spaced, line[1:]))
            out.append(tuple(map(b"".join, zip(*parts, strict=True))))
        return out

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _word(self, chunk: str, front: str) -> list[int] | None:
        """A's ids of a chunk that is a word, or one with a sign behind it: each is one piece.  None for all others."""
        stop = "" if chunk.isalpha() else chunk[-1:]
        body = chunk[:-1] if stop else chunk
        if not body.isalpha() or (stop and stop not in STOPS):
            return None
        spelled = body if body.isascii() else "".join(map(self.letters.__getitem__, body.encode()))
        return [t.id for t in self.tokenize(front + spelled)] + ([t.id for t in self.tokenize(stop)] if stop else [])

    def _learn(self, memory: Remembered, chunks: set[str], spaced: bool) -> None:
        new = memory.pending(chunks)
        front = self.letters[0x20] if spaced else ""
        a = [self._word(c, front) for c in new]
        others = [i for i, ids in enumerate(a) if ids is None]
        for i, e in zip(others, self.a.encode_batch_fast([" " + new[i] if spaced else new[i] for i in others], add_special_tokens=False), strict=True):
            a[i] = e.ids
        if spaced:
            b = [ids if c else [self.space] for c, ids in zip(new, self.b.encode(new, num_threads=1), strict=True)]
        else:
            b = [ids[1 + len(self.feed) :] if c != "\n" else self.feed for c, ids in zip(new, self.b.encode(["\n" + c for c in new], num_threads=1), strict=True)]
        memory.update((c, (self._packed(x), self._packed(y))) for c, x, y in zip(new, a, b, strict=True))

    def cut_alike(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the tokens of both sides, joined, are a space and the text."""
        whole = b" " + text.encode()
        return b"".join(map(self.a_bytes.__getitem__, a.tolist())) == whole and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == whole


def sides_of(a_file: bytes, b_file: bytes) -> Sides:
    """One for each process."""
    key = hashlib.md5(a_file + b_file).hexdigest()
    if key not in _MADE:
        _MADE[key] = Sides(a_file, b_file)
    return _MADE[key]


class Aligned:
    """The links and groups of some documents.  ``a``, ``b``: the ids of all, one document after the other; ``n_a``, ``n_b``: how many of each."""

    def __init__(self, sides: Sides, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        docs = np.arange(len(n_a))
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        self.a_doc, self.b_doc = np.repeat(docs, n_a), np.repeat(docs, n_b)
        self.a_end, self.b_end = np.cumsum(sides.a_sizes[a]), np.cumsum(sides.b_sizes[b])  # places in all texts together
        left = pd.DataFrame({"start": self.a_end - sides.a_sizes[a], "doc": self.a_doc, "i": np.arange(len(a))})
        right = pd.DataFrame({"start": self.b_end - sides.b_sizes[b], "doc": self.b_doc, "j": np.arange(len(b))})
        in_b = pd.merge_asof(left, right, on="start", by="doc")
        in_a = pd.merge_asof(right, left.rename(columns={"start": "begins"}), left_on="start", right_on="begins", by="doc")
        in_a = in_a[in_a["begins"] < in_a["start"]]
        #: the overlapping tokens, as places in ``a`` and ``b``
        self.i = np.concatenate([in_b["i"].to_numpy(), in_a["i"].to_numpy("int64")])
        self.j = np.concatenate([in_b["j"].to_numpy("int64"), in_a["j"].to_numpy()])
        total = int(self.a_end[-1]) if len(a) else 0
        ends = np.zeros(total + 1, bool)
        ends[self.b_end] = True
        self.a_closes = ends[self.a_end]
        ends[:] = False
        ends[self.a_end] = True
        self.b_closes = ends[self.b_end]
        self.n_groups = np.bincount(self.a_doc[self.a_closes], minlength=len(n_a))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, links) of the distinct pairs of each document, in order."""
        key, n = np.unique(self.a_doc[self.i] * np.int64(SHIFT * SHIFT) + self.a[self.i] * np.int64(SHIFT) + self.b[self.j], return_counts=True)
        return key // (SHIFT * SHIFT), key % (SHIFT * SHIFT), n

    def group_texts(self, sides: Sides) -> list[str]:
        """The groups of each document: ids of A, a bar, ids of B, with semicolons between groups."""
        a_group, b_group = np.cumsum(self.a_closes) - self.a_closes, np.cumsum(self.b_closes) - self.b_closes
        a_before = np.r_[0, np.flatnonzero(self.a_closes) + 1]  # tokens of A before each group, and at the end
        b_before = np.r_[0, np.flatnonzero(self.b_closes) + 1]
        out = np.empty(len(self.a) + len(self.b), "int64")
        out[np.arange(len(self.a)) + b_before[a_group]] = self.a + np.where(self.a_closes, sides.size, 0)
        b_sign = np.where(self.b_closes, 2 * sides.size, 0)
        b_sign[np.cumsum(self.n_b) - 1] = 3 * sides.size  # nothing behind the last of a document
        out[np.arange(len(self.b)) + a_before[np.minimum(b_group + 1, len(a_before) - 1)]] = self.b + b_sign
        cut = np.r_[0, np.cumsum(self.n_a + self.n_b)]
        of = sides.decimals.__getitem__
        return ["".join(map(of, out[cut[d] : cut[d + 1]].tolist())) for d in range(len(self.n_a))]


class _Sums:
    """Numbers of pairs, added up until too many are held."""

    def __init__(self, most: int) -> None:
        self.most, self.held, self.size = most, [], 0

    def add(self, pair: np.ndarray, n: np.ndarray) -> bool:
        """Whether it is time to ``take`` what is held."""
        self.held.append((pair, n))
        self.size += len(pair)
        if self.size > 2 * self.most:
            self.held = [self.take()]
            self.size = len(self.held[0][0])
        return self.size > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, "int64"), np.empty(0, "int64")
        pair, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.argsort(pair, kind="stable")
        pair, n = pair[order], n[order]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, "int64")
        return pair[first], np.add.reduceat(n, first) if len(pair) else n


_PAIRS = T.StructType([T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("links", T.ArrayType(T.LongType()))])
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _lists(cut: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, pa.int64()))


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """The first pass: uid, ``id_col``, n_a, n_b, n_groups, n_links, groups (a digest; with ``texts`` the text), pairs, links of each document.

    Rows without a uid hold sums over documents of a task: pairs and links alone.
    """
    spark = df.sparkSession
    short_batches(spark)
    files = spark.sparkContext.broadcast((read_tokenizer(a_path), read_tokenizer(b_path)))  # two vocabulary files: a fixed size, two megabytes
    kind = df.schema[id_col].dataType
    names = ["uid", id_col, *_NUMBERS, "groups", "pairs", "links"]
    fields = [T.StructField("uid", T.LongType()), T.StructField(id_col, kind), *[T.StructField(n, T.LongType()) for n in _NUMBERS], T.StructField("groups", T.StringType()), *_PAIRS.fields]

    def rows(sides: Sides, ids: pa.Array, texts_of: list[str | None], sums: _Sums, number: Iterator[int]) -> Iterator[pa.RecordBatch]:
        known = [i for i, t in enumerate(texts_of) if t]
        coded = [tuple(np.frombuffer(x, "uint32").astype("int64") for x in c) for c in sides.encode([texts_of[i] for i in known])]
        alike = [(i, *c) for i, c in zip(known, coded, strict=True) if sides.cut_alike(texts_of[i], *c)]
        numbers, groups = np.zeros((4, len(texts_of)), "int64"), [""] * len(texts_of)
        cut, pair, n = np.zeros(len(texts_of) + 1, "int64"), np.empty(0, "int64"), np.empty(0, "int64")
        if alike:
            at = np.array([i for i, _, _ in alike])
            done = Aligned(sides, np.concatenate([a for _, a, _ in alike]), np.concatenate([b for _, _, b in alike]), np.array([len(a) for _, a, _ in alike]), np.array([len(b) for _, _, b in alike]))
            doc, pair, n = done.pairs()
            numbers[:, at] = done.n_a, done.n_b, done.n_groups, np.bincount(done.a_doc[done.i], minlength=len(at))
            for i, text in zip(at.tolist(), done.group_texts(sides), strict=True):
                groups[i] = text if texts else hashlib.sha256(text.encode()).hexdigest()
            cut[at + 1] = np.bincount(doc, minlength=len(at))
            cut = np.cumsum(cut)
        uid = pa.array([next(number) for _ in texts_of], pa.int64())
        yield pa.RecordBatch.from_arrays([uid, ids, *[pa.array(x) for x in numbers], pa.array(groups, pa.string()), _lists(cut, pair), _lists(cut, n)], names=names)
        if sums.add(pair, n):
            yield from summed(sums, ids.type)

    def summed(sums: _Sums, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        pair, n = sums.take()
        for at in range(0, len(pair), 1 << 16):
            one = np.array([0, len(pair[at : at + (1 << 16)])])
            nothing = [pa.nulls(1, t) for t in (pa.int64(), id_type, *[pa.int64()] * 4, pa.string())]
            yield pa.RecordBatch.from_arrays([*nothing, _lists(one, pair[at : at + (1 << 16)]), _lists(one, n[at : at + (1 << 16)])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, sums, number, id_type = sides_of(*files.value), _Sums(HELD_PAIRS), itertools.count(TaskContext.get().partitionId() << 40), None
        for batch in batches:
            id_type, first, held, all_texts = batch.column(0).type, 0, 0, batch.column(1).to_pylist()
            for i, text in enumerate(all_texts):
                held += len(text or "")
                if held > BATCH_BYTES or i + 1 == len(all_texts):
                    yield from rows(sides, batch.column(0).slice(first, i + 1 - first), all_texts[first : i + 1], sums, number)
                    first, held = i + 1, 0
        if id_type is not None:
            yield from summed(sums, id_type)

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, T.StructType(fields))


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (its links in the corpus), best (whether no pair of its B id has more) from the sums of ``align``."""
    sums = found.filter("uid is null").select(F.inline(F.arrays_zip("pairs", "links"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("links").alias("n"))
    sums = kept(sums.withColumn("b", F.col("pair") % SHIFT))
    highest = sums.groupBy("b").agg(F.max("n").alias("highest"))  # one row for each id of B
    return kept(sums.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")))


def scored(found: DataFrame, counts: DataFrame, id_col: str = "doc_id", most_common: int = MOST_COMMON) -> DataFrame:
    """The documents of ``align`` with n_best and count_sum."""
    spark = found.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.filter(F.col("n") * most_common >= F.lit(total))
    top = common.toPandas().sort_values("pair")  # each has one of most_common of the total, so they are no more than that
    shared = spark.sparkContext.broadcast((top["pair"].to_numpy("int64"), top["n"].to_numpy("int64"), top["best"].to_numpy("bool")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 2)
            counted = lists.value_lengths().to_numpy(zero_copy_only=False).astype("int64")
            asked, links = lists.flatten().to_numpy(), batch.column(batch.num_columns - 1).flatten().to_numpy()
            doc, at = np.repeat(np.arange(len(counted)), counted), np.minimum(np.searchsorted(pair, asked), max(len(pair) - 1, 0))
            hit = pair[at] == asked if len(pair) else np.zeros(len(asked), bool)
            at, by = at[hit], doc[hit]
            # sums of 64-bit numbers, exact where float weights would not be
            n_best, count_sum = np.zeros(len(counted), "int64"), np.zeros(len(counted), "int64")
            np.add.at(n_best, by, links[hit] * best[at])
            np.add.at(count_sum, by, links[hit] * n[at])
            rest = np.r_[0, np.cumsum(np.bincount(doc[~hit], minlength=len(counted)))]
            front = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*front, pa.array(n_best), pa.array(count_sum), _lists(rest, asked[~hit]), _lists(rest, links[~hit])], names=names)

    columns = ["uid", id_col, *_NUMBERS, "groups"]
    names = [*columns, "n_best", "count_sum", "pairs", "links"]
    known = [found.schema[c] for c in columns]
    schema = T.StructType([*known, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), *_PAIRS.fields])
    looked = kept(found.filter("uid is not null").select(*[F.col(f"`{c}`") for c in columns], "pairs", "links").mapInArrow(run, schema))
    rare = looked.filter(F.size("pairs") > 0).select("uid", F.inline(F.arrays_zip("pairs", "links"))).withColumnRenamed("pairs", "pair")
    rare = rare.join(counts.filter(F.col("n") * most_common < F.lit(total)), "pair").select("uid", F.when(F.col("best"), F.col("links")).otherwise(0).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum"))
    more = rare.groupBy("uid").agg(F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_sum"))
    both = looked.drop("pairs", "links").join(more, "uid", "left")
    return both.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).drop("more_best", "more_sum")


def aligned(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most_common: int = MOST_COMMON) -> DataFrame:
    """``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    found = kept(align(df, a_path, b_path, id_col, text_col), {"compression": "zstd"})
    out = scored(found, pair_counts(found), id_col, most_common)
    return out.select(F.col(f"`{id_col}`"), *_NUMBERS, "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
