"""The number of documents that importance resampling draws."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from atrium.llm import resampling


def test_adjusted_count():
    assert resampling.good_rows(1000, 600, np.array([True] * 9 + [False]), np.array([True] + [False] * 9), 0.0) == round(1000 * (0.6 - 0.1) / 0.8)
    assert resampling.good_rows(1000, 600, np.array([True] * 37 + [False]), np.array([False] * 9)) == 600  # one label may be wrong
    assert resampling.good_rows(1000, 600, np.array([True, False]), np.array([])) == 1000  # never more than there are
    assert resampling.good_rows(1000, 30, np.array([True]), np.array([True, False])) == 0
    assert resampling.good_rows(50, 20, np.array([False]), np.array([True])) == 20  # rates that say nothing
    assert resampling.good_rows(0, 0, np.array([True]), np.array([])) == 0


def mixed(n, share_good, seed):
    """Texts of two overlapping vocabularies, so that no bar tells them apart."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < share_good
        words = [f"{'g' if (rng.random() < (0.56 if good else 0.44)) else 'b'}{rng.randrange(40)}" for _ in range(60)]
        rows.append((i, " ".join(words), good))
    return rows


def test_k_is_the_number_of_good_rows_and_not_of_those_at_the_bar(spark):
    rows = mixed(4000, 0.3, 1)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    # labels hold as many good as bad rows, though seven of ten rows are bad
    good, bad = [r[0] for r in rows if r[2]][:600], [r[0] for r in rows if not r[2]][:600]
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(i, 0, 0) for i in bad], "doc_id long, quality int, toxic int")
    truth = sum(r[2] for r in rows)
    done = resampling.resample(df, labels).select("doc_id", "_key", "_kept").collect()
    k = sum(r._kept for r in done)
    assert abs(k - truth) <= 0.2 * truth
    keys = sorted((r._key for r in done), reverse=True)
    assert all(r._kept == (r._key >= keys[k - 1]) for r in done)  # the k largest keys
    held = {i: np.array([r._key for r in done if r.doc_id in set(ids)]) for i, ids in ((True, good), (False, bad))}
    bar = resampling.best_bar(held[True], held[False], 1.0)
    assert abs(sum(x >= bar for x in keys) - truth) > abs(k - truth)  # a bar alone would keep too many of the bad


def test_shares_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    done = resampling.quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id")
    share = {r.quality: r.share for r in done.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] >= 0.98 and share[0] <= 0.1
