"""Operator 6: quality by importance resampling.

Two bag-of-n-grams models over hashed words and word pairs are counted: one of the target (texts labelled
good), one of the raw corpus (every text).  A document's weight is the mean log ratio of the two over its
n-grams, times a fixed effective length, so that long and short texts compare; adding Gumbel noise and taking
the k largest samples k documents without replacement in proportion to their weights.

The mean times a fixed length stands for the sum that a likelihood ratio has: a sum over thousands of n-grams would
drown the Gumbel noise and let length decide; this way every text counts as one of 100 n-grams.

Counts have a fixed number of buckets, so the models have a fixed size at any scale.  The raw counts cover
all rows; the target comes from at most ``most_labelled`` labelled rows (those of smallest hash), whose ids are
broadcast.  ``k`` may be given; else it is the estimated number of good documents in the whole table.  One half of the
labelled good rows makes the target; the other half, and as many labelled bad ones (quality 0) at most, say how many good and how many
bad documents reach a test bar (the one at which the fewest labels are decided wrongly).  From these two rates and the share of all rows that
reach it follows the share of good rows, whatever the mix of the labels is: an adjusted count, share = (reached - bad rate) / (good rate - bad
rate), where up to three in a hundred labels of a kind may be wrong.  Toxic rows are in neither half.  Then the ``k`` largest keys (weight and noise) of the whole
table are drawn; where the draw ends is what the keys give.  The noise is a hash of id and text, so a rerun draws the same.

The mean over n-grams sees what a text is made of, not a few words in it: a toxic text that is good otherwise (about
five insult words) has nearly the weight of a clean one and is kept.

Defined cases: text that is null or has no word has no weight and is rejected; without labelled good rows all texts
with words are kept; without labelled bad rows the bar is what all but ``loss`` of the held-out good ones reach; an id
that is labelled twice is good only if it is never bad; rows with equal ids and texts share their key and their fate, so a tie at the
``k``-th key keeps all of its rows; texts may have any length (a task holds the n-grams of one batch); an empty table
gives none; ``df`` keeps all columns, but for names of its own with a leading underscore (_n_grams, _log_ratio, _key, _kept).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atrium.llm.chunks import Memory
from atrium.llm.common import kept, short_batches

BUCKETS = 10_000
EFFECTIVE_LENGTH = 100.0


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


def grams(texts: list[str | None], memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and neighbouring word pairs, and which text each is from."""
    words = [np.fromiter(map(memory.__getitem__, (t or "").split()), "int64") for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    word = np.concatenate(words) if words else np.empty(0, "int64")
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    pair = (word[inside] * 0x9E3779B1 + word[inside + 1] * 0x85EBCA6B & 0xFFFFFFFF) ^ 0x5BD1E995
    return np.concatenate([word % BUCKETS, (pair ^ pair >> 15) % BUCKETS]), np.concatenate([doc, doc[inside]])


def models(df: DataFrame, target: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log ratio of target to raw for each bucket.  ``target``: ids of a bounded set of rows, column ``id``, beside ``df``'s ``_id``."""
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, raw, good = Memory(_hash, 200_000), np.zeros(BUCKETS, "int64"), np.zeros(BUCKETS, "int64")
        for batch in batches:
            bucket, doc = grams(batch.column(0).to_pylist(), memory)
            chosen = batch.column(1).to_numpy(zero_copy_only=False)
            raw += np.bincount(bucket, minlength=BUCKETS)
            good += np.bincount(bucket[chosen[doc]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(good)], names=["bucket", "raw", "good"])

    marked = df.join(F.broadcast(target.withColumn("_chosen", F.lit(True))), df["_id"] == target["id"], "left")
    marked = marked.select(text_col, F.coalesce("_chosen", F.lit(False)).alias("chosen"))
    total = marked.mapInArrow(run, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for row in total.collect():  # one row for each bucket
        raw[row.bucket] += row.raw
        good[row.bucket] += row.good
    if good.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def keyed(df: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """All columns of ``df`` with _n_grams, _log_ratio (mean), _key (weight with Gumbel noise; null without words)."""
    short_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ratio)  # 10,000 doubles
    schema = T.StructType([*df.schema.fields, T.StructField("_n_grams", T.LongType()), T.StructField("_log_ratio", T.DoubleType()), T.StructField("_key", T.DoubleType())])
    at_text, at_id, n = df.columns.index(text_col), df.columns.index(id_col), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, weight = Memory(_hash, 200_000), shared.value
        for batch in batches:
            texts = batch.column(at_text).to_pylist()
            bucket, doc = grams(texts, memory)
            count = np.bincount(doc, minlength=len(texts))
            mean = np.bincount(doc, weight[bucket], len(texts)) / np.maximum(count, 1)
            marks = [zlib.crc32(f"{seed}|{i}|{t}".encode("utf-8", "replace")) for i, t in zip(batch.column(at_id).to_pylist(), texts, strict=True)]
            u = (np.array(marks, "float64") + 0.5) / 2**32
            key = EFFECTIVE_LENGTH * mean - np.log(-np.log(u))
            none = count == 0
            arrays = [batch.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(count, pa.int64()), pa.array(mean, mask=none), pa.array(key, mask=none)], names=[*batch.schema.names[:n], "_n_grams", "_log_ratio", "_key"])

    return df.mapInArrow(run, schema)


def kth_largest(keys: DataFrame, k: int, column: str = "_key", few: int = 4096) -> float | None:
    """The ``k``-th largest value, found by counting in ever narrower ranges; only counts and at most about ``few`` values leave Spark."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < k or k < 1:
        return None if k < 1 else low
    above = 0
    while True:
        inside = keys.filter(F.col(column).between(low, high))
        step = (high - low) / 256
        if step <= abs(high) * 1e-15:
            return low
        slot = F.least(F.floor((F.col(column) - low) / step), F.lit(255)).cast("int")
        counts = {r.s: (r.n, r.a, r.b) for r in inside.groupBy(slot.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()}
        for s in sorted(counts, reverse=True):
            n, a, b = counts[s]
            if above + n >= k:
                break
            above += n
        if n <= few:
            found = sorted((r[0] for r in keys.filter(F.col(column).between(a, b)).select(column).collect()), reverse=True)
            return found[k - above - 1]
        if a == b:
            return a
        low, high = a, b


def best_bar(good: np.ndarray, bad: np.ndarray, weight: float = 1.0) -> float:
    """The bar that decides the fewest held-out labels wrongly, where a bad one counts as ``weight`` good ones; the lowest one if several do.

    It lies midway between the last key that it rejects and the first that it keeps, which is a good one.
    """
    good, bad = np.sort(good), np.sort(bad)
    wrong = np.arange(len(good)) + weight * (len(bad) - np.searchsorted(bad, good))
    first = good[np.argmin(wrong)]
    below = np.concatenate([good[good < first], bad[bad < first]])
    return float((first + below.max()) / 2 if len(below) else first)


def good_rows(every: int, reached: int, good: np.ndarray, bad: np.ndarray, noise: float = 0.03) -> int:
    """How many of ``every`` rows are good, if so many ``reached`` a bar that held-out ``good`` and ``bad`` ones reached or not.

    Of the labels of each kind a share of ``noise`` may be wrong: so many misses, and so many false hits, are put down to the labels.
    """
    hit, false_hit = min(1.0, float(good.mean()) + noise), max(0.0, float(bad.mean()) - noise) if len(bad) else 0.0
    if hit <= false_hit:
        return reached
    return round(every * min(1.0, max(0.0, (reached / max(every, 1) - false_hit) / (hit - false_hit))))


def drawn(df: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = 20_000, loss: float = 0.002, seed: int = 0) -> tuple[np.ndarray, DataFrame, float | None]:
    """The log ratios, the rows' numbers (_id, _n_grams, _log_ratio, _key), and the ``k``-th largest key (None: no row is drawn).

    ``labels``: doc_id, quality (0 or 1), toxic (0 or 1).  The target is quality 1 without toxic ones.
    """
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    good, bad = known.filter("quality = 1 and toxic = 0").select("id"), known.filter("quality = 0").select("id")
    part = lambda ids: ids.orderBy(F.xxhash64("id", F.lit(seed))).limit(most_labelled)
    tested = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) == 1
    sample = kept(part(good).withColumn("good", F.lit(True)).union(part(bad).withColumn("good", F.lit(False))))
    target = sample.filter(~tested & F.col("good")).select("id")
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`"))
    ratio = models(rows, target, text_col)
    asked = sample.filter(tested | ~F.col("good"))
    marks = kept(keyed(rows, ratio, "_id", text_col, seed).drop(text_col))  # numbers only
    if k is None:
        held = marks.join(F.broadcast(asked), F.col("_id") == F.col("id")).filter("_key is not null")
        held = held.groupBy("_id", "good").agg(F.min("_key").alias("key")).select("good", "key").toPandas()  # one row for each sampled id
        keys = {g: held.loc[held["good"] == g, "key"].to_numpy("float64") for g in (True, False)}
        if not len(keys[True]):
            bar = None
        elif not len(keys[False]):
            bar = float(np.quantile(keys[True], loss))
        else:  # each sampled label stands for as many of its kind
            all_of = {r.quality: r.n for r in known.filter("quality = 0 or toxic = 0").groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
            asked_of = {r.good: r.n for r in asked.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
            bar = best_bar(keys[True], keys[False], all_of[0] / asked_of[False] / (all_of[1] / asked_of[True]))
        every, reached = marks.agg(F.count("_key"), F.count_if(F.col("_key") >= bar) if bar is not None else F.count("_key")).first()
        k = every if bar is None else good_rows(every, reached, keys[True] >= bar, keys[False] >= bar)
    return ratio, marks, kth_largest(marks.select("_key"), k)


def resample(df: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = 20_000, loss: float = 0.002, seed: int = 0) -> DataFrame:
    """All columns of ``df`` with _n_grams, _log_ratio, _key and _kept: whether the key is one of the ``k`` largest."""
    ratio, _, least = drawn(df, labels, k, id_col, text_col, most_labelled, loss, seed)
    return keyed(df, ratio, id_col, text_col, seed).withColumn("_kept", _reaches(least))


def _reaches(least: float | None) -> Column:
    return F.coalesce(F.col("_key") >= F.lit(least), F.lit(False)) if least is not None else F.lit(False)


def quality(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_grams, log_ratio, key, kept of every document."""
    _, marks, least = drawn(df, labels)
    return marks.select(F.col("_id").alias("doc_id"), F.col("_n_grams").alias("n_grams"), F.col("_log_ratio").alias("log_ratio"), F.col("_key").alias("key"), _reaches(least).alias("kept"))
