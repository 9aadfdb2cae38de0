"""Operator 3: packing documents into windows by lexical retrieval.

The terms of a text are its distinct token ids with their counts, so the corpus statistics (document frequencies, mean length)
have the size of the vocabulary and cover every row.  Documents are dealt into shards by the smallest hash of
their token pairs, which brings texts with common wording together.  A shard is bounded in tokens and in documents: loads of
262,144 ranges of that hash are added up, light neighbours share a shard, and a heavy range (a group of copies of any size)
is split by row, so rows with equal ids and texts spread too.  Each shard has its own BM25 inverted index.  In a shard
the next unused document seeds a window; the index is asked with all its terms and returns its unused neighbours,
best first (ties to the earlier row), and they fill the window.  The document that crosses a window's end is cut there and its rest
seeds the next one, so only the tail of a shard could need padding, and that is cut into powers of two, which need none.

Defined cases: null and empty texts are the end id alone; rows with equal or null ids are packed like others, each whole; a text
with more tokens than a shard may hold has a shard of its own; an empty table gives no piece; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atrium.llm.common import kept, short_batches
from atrium.llm.library_tokens import encoder, read_tokenizer

K1, B = 1.2, 0.75
#: Tokens and documents of a shard, about.
SHARD_TOKENS, SHARD_ROWS = 1 << 21, 2048
RANGES = 1 << 18
#: Posting lists that are laid out at once.
TERM_BLOCK = 2048


def wording(ids: np.ndarray) -> int:
    """A 32-bit hash of the smallest hash of two neighbouring ids (of a single id with itself)."""
    ids = ids.astype("uint64")
    first, second = (ids[:-1], ids[1:]) if len(ids) > 1 else (ids, ids)
    x = (first << np.uint64(32) | second) * np.uint64(0x9E3779B97F4A7C15)
    least = int(((x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)).min())
    return zlib.crc32(least.to_bytes(8, "little"))


def vocabulary_size(model: bytes) -> int:
    made = json.loads(model)
    return 1 + max([*made["model"]["vocab"].values(), *(t["id"] for t in made.get("added_tokens", []))], default=0)


def encoded(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """One row per document: doc_id, row (a number of its own), its ids as bytes, n_tokens and its range; and the type of an id.

    Each task adds one row with the document frequencies of its part (``frequencies``, else null).
    """
    spark = df.sparkSession
    short_batches(spark)
    file = read_tokenizer(tokenizer_path)
    model = spark.sparkContext.broadcast(file)  # a vocabulary file: a fixed size, under 2 MB
    size = max(vocabulary_size(file), end_id + 1)
    width = "<u2" if size <= 1 << 16 else "<u4"
    names = ["doc_id", "row", "ids", "n_tokens", "range", "frequencies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model.value, False)
        end = np.array([end_id], "<u4").tobytes()
        total, row, kind = np.zeros(size, "int64"), TaskContext.get().partitionId() << 33, None
        last = np.zeros(size, "int64")
        for batch in batches:
            ids, counts, ranges = [], [], []
            kind = batch.schema.field(0).type
            for text in batch.column(1).to_pylist():
                own = np.frombuffer(encode(text or "") + end, "<u4")
                ids.append(own.astype(width).tobytes())
                counts.append(len(own))
                ranges.append(wording(own) % RANGES)
                place = np.arange(len(own))
                last[own] = place
                total[own[last[own] == place]] += 1  # each distinct id at its last place
            n = batch.num_rows
            columns = [pa.array(np.arange(row, row + n)), pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array(ranges, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))]
            row += n
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)
        if kind is not None:
            counted = [pa.nulls(1, kind), *[pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.int64())], pa.array([total.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(counted, names=names)

    kinds = [df.schema[id_col].dataType, T.LongType(), T.BinaryType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType())]
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(names, kinds, strict=True)])
    return kept(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema), {"compression": "zstd"}), width


def inverse_frequencies(table: DataFrame, n: int) -> np.ndarray:
    """BM25's weight of each term, from the document frequencies of the whole corpus: one number for each entry of the vocabulary."""
    parts = table.filter("frequencies is not null").select(F.posexplode("frequencies").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in parts.toLocalIterator()}
    frequency = np.array([found.get(i, 0) for i in range(max(found, default=0) + 1)], "float64")
    return np.log1p((n - frequency + 0.5) / (frequency + 0.5))


def shards_of_ranges(ranges: list[tuple[int, int, int]], most_tokens: int, most_rows: int) -> list[tuple[int, int, int]]:
    """(range, tokens, rows) -> (range, first shard, shards): light neighbours share a shard, a heavy range has several."""
    out, shard, load = [], 0, 0.0
    for number, tokens, rows in sorted(ranges):
        own = max(tokens / most_tokens, rows / most_rows)
        if load and load + own > 1:
            shard, load = shard + 1, 0.0
        parts = max(1, int(np.ceil(own)))
        out.append((number, shard, parts))
        load += own
        if parts > 1:
            shard, load = shard + parts, 0.0
    return out


def scores(terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """``scores[seed, other]``: BM25 of ``other`` for all distinct terms of ``seed``, from the posting lists of one shard."""
    n = len(lengths)
    doc = np.repeat(np.arange(n), [len(t) for t in terms])
    term, tf = np.concatenate(terms).astype("int64"), np.concatenate(counts).astype("float64")
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))
    by_term = np.argsort(term, kind="stable")
    term, doc, weight = term[by_term], doc[by_term], weight[by_term].astype("float32")
    known, begin = np.unique(term, return_index=True)
    size = np.diff(np.r_[begin, len(term)])
    lists = np.flatnonzero(size > 1)  # a term of one document leads to no other
    total = np.zeros((n, n), "float32")
    for at in range(0, len(lists), TERM_BLOCK):
        some = lists[at : at + TERM_BLOCK]
        spot = np.repeat(begin[some] - np.r_[0, np.cumsum(size[some])[:-1]], size[some]) + np.arange(size[some].sum())
        column = np.repeat(np.arange(len(some)), size[some])
        has, worth = np.zeros((n, len(some)), "float32"), np.zeros((n, len(some)), "float32")
        has[doc[spot], column], worth[doc[spot], column] = 1, weight[spot]
        total += has @ worth.T
    return total


def filling_order(score: np.ndarray, lengths: np.ndarray, window: int) -> list[int]:
    """The order in which one shard's documents follow each other."""
    n = len(lengths)
    free = np.ones(n, bool)
    order: list[int] = []
    at, cursor, seed = 0, 0, None
    while len(order) < n:
        pick = None
        if seed is not None and at % window:
            near = score[seed] * free
            best = int(near.argmax())
            pick = best if near[best] > 0 else None
        if pick is None:
            while not free[cursor]:
                cursor += 1
            pick = seed = cursor
        free[pick] = False
        order.append(pick)
        before, at = at // window, at + int(lengths[pick])
        if at // window > before:
            seed = pick
    return order


def cuts(total: int, window: int) -> np.ndarray:
    """Where sequences begin, and the end: whole windows, then powers of two."""
    at = list(range(0, total - total % window + 1, window))
    rest = total % window
    while rest:
        step = 1 << (rest.bit_length() - 1)
        at.append(at[-1] + step)
        rest -= step
    return np.array(at, "int64")


def pack(df: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, shard_rows: int = SHARD_ROWS, digests: bool = False) -> DataFrame:
    """Packs every document with ``end_id`` after it.

    Returns one row per piece: doc_id, start, length, ids (array of int; with ``digests`` its CRC-32
    ``ids_crc32`` instead), doc_tokens, sequence_id, offset.
    """
    table, width = encoded(df, tokenizer_path, end_id, id_col, text_col)
    rows = table.filter("frequencies is null").drop("frequencies")
    loads = [tuple(r) for r in rows.groupBy("range").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()]  # a row for each range
    n, tokens = sum(r[2] for r in loads), sum(r[1] for r in loads)
    mean = tokens / n if n else 1.0
    spark = df.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequencies(table, n))  # a double for each entry of the vocabulary
    plan = spark.createDataFrame(shards_of_ranges(loads, shard_tokens, shard_rows), "range long, first long, parts long")
    names = ["doc_id", "start", "length", "ids_crc32" if digests else "ids", "doc_tokens", "sequence_id", "offset"]

    def fill(whole: pa.Table) -> pa.Table:
        whole = whole.sort_by("row")
        ids = [np.frombuffer(x, width) for x in whole["ids"].to_pylist()]
        lengths = np.array([len(x) for x in ids], "int64")
        known = [np.unique(x, return_counts=True) for x in ids]
        order = np.array(filling_order(scores([t for t, _ in known], [c for _, c in known], lengths, idf.value, mean), lengths, window))
        stop = np.cumsum(lengths[order])
        begin = cuts(int(stop[-1]), window)
        edge = np.union1d(np.r_[0, stop], begin)
        left, length = edge[:-1], np.diff(edge)
        which = np.searchsorted(stop, left, side="right")
        doc = order[which]
        start = left - (stop - lengths[order])[which]
        sequence = np.searchsorted(begin, left, side="right") - 1
        pieces = [ids[d][s : s + k].astype("<u4") for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
        third = pa.array([zlib.crc32(p) for p in pieces], pa.int64()) if digests else pa.array([p.astype("int32") for p in pieces], pa.list_(pa.int32()))
        shard = whole["shard"][0].as_py()
        columns = [whole["doc_id"].combine_chunks().take(pa.array(doc)), pa.array(start), pa.array(length), third, pa.array(lengths[doc]), pa.array((shard << 32) + sequence), pa.array(left - begin[sequence])]
        return pa.table(dict(zip(names, columns, strict=True)))

    kinds = [table.schema["doc_id"].dataType, T.LongType(), T.LongType(), T.LongType() if digests else T.ArrayType(T.IntegerType()), *[T.LongType()] * 3]
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(names, kinds, strict=True)])
    shard = F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))
    return rows.join(F.broadcast(plan), "range").select("doc_id", "row", "ids", shard.alias("shard")).groupBy("shard").applyInArrow(fill, schema)
