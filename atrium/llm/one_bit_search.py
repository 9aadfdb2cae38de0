"""Operator 2: nearest neighbours through randomly rotated one-bit codes.

A vector minus the corpus mean is normalised and rotated by a random orthogonal matrix; its code is the
sign of each coordinate, packed into 64-bit words, with two correction scalars: its length and the inner product of the
unit vector with its code.  A query is rotated alike and its coordinates are rounded to four bits, kept as four bit planes.
Counting the bits that a code shares with each plane gives the inner product with the code; divided by the correction it
estimates the true one, with an error bound that holds with high probability.  In a batch the best estimates are measured
exactly; the tenth distance seen so far is the bar, and every vector whose lower bound is under the bar is measured too.

Codes are computed once and stored beside their vectors.  The stated queries are cut into blocks of bounded size;
a block is broadcast, and one pass over the codes gives at most ten rows for each of its queries and each task, of which the
best ten are kept.  Nothing is written for a pair of blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
null ids; a row whose id equals the query's is the query itself; only vectors of equal length meet; equal distances go to
the smaller id; where an id repeats, its query is the smallest of its vectors, and each of its rows is a candidate; an empty
table gives nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atrium.llm.common import kept

#: Standard deviations of the estimate that the bound allows for.
EPSILON = 2.5
#: Bits of a query's coordinate.
PLANES = 4
QUERIES_AT_ONCE = 8192


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words; unused bits are 0."""
    rows, dim = bits.shape
    whole = np.zeros((rows, -(-dim // 64) * 64), bool)
    whole[:, :dim] = bits
    return np.packbits(whole, axis=1).view("uint64")


def code(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, lengths and corrections of the rows of ``vectors`` about ``centre``."""
    away = vectors - centre
    length = np.linalg.norm(away, axis=1)
    unit = away / np.where(length > 0, length, 1)[:, None] @ turn
    return packed(unit > 0), length, np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])


class Query:
    """A query about ``centre``, rotated, in bit planes."""

    def __init__(self, vector: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> None:
        self.vector, self.dim = vector, len(vector)
        away = vector - centre
        self.far = float(np.linalg.norm(away))
        turned = away / (self.far or 1) @ turn
        self.low = float(turned.min())
        self.step = float(turned.max() - self.low) / (2**PLANES - 1) or 1.0
        level = np.rint((turned - self.low) / self.step).astype("uint8")
        self.planes = packed((level >> np.arange(PLANES, dtype="uint8")[:, None] & 1).astype(bool))
        self.total = self.low * self.dim + self.step * float(level.sum())

    def bounds(self, words: np.ndarray, ones: np.ndarray, length: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances of codes, and lower bounds of them.  ``ones``: the bits set in each code."""
        shared = np.zeros(len(words), "int64")
        for i, plane in enumerate(self.planes):
            shared += np.bitwise_count(words & plane).sum(axis=1, dtype="int64") << i
        fit = np.where(fit > 0, fit, 1)
        inner = (2 * (self.low * ones + self.step * shared) - self.total) / np.sqrt(self.dim) / fit
        spread = np.sqrt(np.maximum(0, 1 - fit**2) / max(1, self.dim - 1) + self.step**2 / 12) / fit
        base, scale = length**2 + self.far**2, 2 * length * self.far
        return base - scale * inner, base - scale * np.minimum(1, inner + EPSILON * spread) - 1e-5 * (base + scale)


def _means(rows: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """The mean vector of each length, and how many rows there are."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total[len(v)] = total.get(len(v), 0) + np.array(v)
                count[len(v)] = count.get(len(v), 0) + 1
        flat = [(d, i, float(x), count[d]) for d, t in total.items() for i, x in enumerate(t)]
        yield pa.RecordBatch.from_pylist([dict(zip(("dim", "i", "x", "n"), f, strict=True)) for f in flat], schema=pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("x", pa.float64()), ("n", pa.int64())]))

    # a row for each component of each vector length
    means = rows.select("v").mapInArrow(sums, "dim int, i int, x double, n long").groupBy("dim", "i").agg((F.sum("x") / F.sum("n")).alias("x"), F.sum("n").alias("n")).collect()
    centres: dict[int, np.ndarray] = {}
    n = 0
    for dim in {r.dim for r in means}:
        own = sorted((r.i, r.x, r.n) for r in means if r.dim == dim)
        centres[dim] = np.array([x for _, x, _ in own])
        n += own[0][2]
    return centres, n


def _by_dim(batch: pa.RecordBatch, dims: np.ndarray) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    for dim in np.unique(dims).tolist():
        own = batch.filter(pa.array(dims == dim))
        yield dim, own.column("v").flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dim), own


def search(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """The ``k`` nearest rows of each query (a row whose id ``every`` divides): query_id, rank, vec_id, score."""
    spark = df.sparkSession
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(finite & F.exists("v", lambda x: x != 0))
    centres, _ = _means(rows)
    shared = spark.sparkContext.broadcast(centres)  # a vector for each vector length

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.diff(batch.column("v").offsets.to_numpy())
            for dim, v, own in _by_dim(batch, dims):
                turn = turns.setdefault(dim, rotation(dim) if dim not in turns else turns[dim])
                words, length, fit = code(v, shared.value[dim], turn)
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("v"), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(length), pa.array(fit)], names=["id", "v", "code", "length", "fit"])

    coded = kept(rows.mapInArrow(codes, "id long, v array<double>, code binary, length double, fit double"))
    asked = kept(coded.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id", F.size("v").alias("dim")).agg(F.min("v").alias("v")))
    blocks = max(1, -(-asked.count() // at_once))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "dim"), F.lit(blocks)))
    found = None
    for number in range(blocks):
        block: dict[int, list[tuple[int, np.ndarray]]] = {}
        for r in asked.filter(F.col("block") == number).collect():  # a bounded block of queries
            block.setdefault(r.dim, []).append((r.id, np.array(r.v)))
        queries = spark.sparkContext.broadcast(block)
        near = coded.mapInArrow(_nearest(queries, shared, k), "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        best = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        best = kept(best) if blocks > 1 else best
        found = best if found is None else found.union(best)
    return found


def _nearest(queries, centres, k: int):
    """A pass over codes: at most ``k`` rows for each query of the broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {}
        for dim, own in queries.value.items():
            turn = rotation(dim)
            made[dim] = [(q, Query(v, centres.value[dim], turn)) for q, v in own]
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, v, own in _by_dim(batch, np.diff(batch.column("v").offsets.to_numpy())):
                ids, length, fit = (own.column(c).to_numpy() for c in ("id", "length", "fit"))
                words = np.frombuffer(b"".join(own.column("code").to_pylist()), "uint64").reshape(len(ids), -1)
                ones = np.bitwise_count(words).sum(axis=1, dtype="int64")
                for q, query in made.get(dim, ()):
                    known_ids, known = best.get((q, dim), (np.empty(0, "int64"), np.empty(0)))
                    estimate, low = query.bounds(words, ones, length, fit)
                    mine = ids == q
                    estimate[mine] = low[mine] = np.inf
                    bar = known[-1] ** 2 if len(known) == k else np.inf
                    if bar == np.inf:
                        first = np.argpartition(estimate, k)[:k] if len(ids) > k else np.flatnonzero(~mine)
                        first = first[~mine[first]]
                        bar = ((v[first] - query.vector) ** 2).sum(axis=1).max() if len(first) == k else np.inf
                    near = np.flatnonzero((low <= bar * (1 + 1e-9)) & ~mine)
                    score = np.r_[known, np.sqrt(((v[near] - query.vector) ** 2).sum(axis=1))]
                    both = np.r_[known_ids, ids[near]]
                    chosen = np.lexsort((both, score))[:k]
                    best[q, dim] = both[chosen], score[chosen]
        for (q, _), (ids, score) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run
