"""The pipeline's stages on small documents."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("component_id", "_kept", "score", "lang_pred", "row", "_found", "_key"):  # names of the operators' own
        docs = docs.withColumn(name, F.lit(7))
    key = hashlib.sha1(b"secret").hexdigest()
    first = docs.first()
    extra = [(None, None, "en", "s", 0, 7, 7, 7, 7, 7, 7, 7), (90001, "...", "en", "s", 3, 7, 7, 7, 7, 7, 7, 7), (90002, first.text, "en", "s", 3, 7, 7, 7, 7, 7, 7, 7), (90003, first.text.replace(" ", f' token = "{key}" ', 1), "en", "s", 3, 7, 7, 7, 7, 7, 7, 7)]
    rows = docs.union(spark.createDataFrame(extra, docs.schema))
    seen = rows
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = spark.createDataFrame(stage(spark, seen, SF).collect(), rows.schema)
        assert seen.columns == rows.columns
        counts[name] = seen.count()
    assert 90001 not in [r.doc_id for r in seen.collect()]
    assert counts["language_id"] >= 195 and counts["quality"] >= 0.8 * counts["language_id"]
    ids = [r.doc_id for r in seen.collect()]
    assert len(ids) == len(set(ids)) and 90002 not in ids
    assert not seen.filter(F.contains("text", F.lit(key))).count()
    assert {tuple(r) for r in seen.select("component_id", "_kept", "score", "lang_pred", "row", "_found", "_key").distinct().collect()} == {(7,) * 7}
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert packed.select("doc_id").distinct().count() == len(ids)


def test_near_duplicate_stage_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(400)}" for _ in range(200)]
    rows = []
    for i in range(60):
        own = [w if rng.random() > 0.01 * (i % 6) else "edit" + str(rng.random()) for w in (words if i % 3 else rng.sample(words, 40))]
        rows.append((i, " ".join(own), "en", i))
    rows += [(7, rows[7][1], "en", 7), (7, rows[7][1], "de", 7), (None, rows[1][1], "en", 0), (61, None, "en", 0), (62, "", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `page no` int")
    groups, _ = brute_groups([(i, t) for i, t, *_ in rows if i is not None])
    want = sorted([(i, t, lang, n) for i, t, lang, n in {r for r in rows if r[0] != 7 or r[2] == "de"} if i is None or groups[i] == i], key=str)
    assert sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=str) == want
    assert len(want) < 60


def test_quality_and_language_stages_reject(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("page no", F.lit(1))
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    left = {r.doc_id for r in corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.01").collect()}
    good, bad = [i for i, r in labels.items() if r.quality == 1 and not r.toxic], [i for i, r in labels.items() if r.quality == 0]
    assert sum(i in left for i in good) >= 0.97 * len(good) and sum(i in left for i in bad) <= 0.25 * len(bad)
    extra = spark.createDataFrame([(10**6, "½ ² 123 ...", "en"), (10**6 + 1, None, "en")], "doc_id long, text string, lang string")
    seen = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(extra, allowMissingColumns=True), SF).collect()}
    assert not {10**6, 10**6 + 1} & seen and len(seen) >= 0.97 * docs.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
