"""A pipeline from raw documents to packed training windows.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the last keep the columns of ``documents``, whatever
their names and types, in their order.

Defined cases, for all stages: an empty table gives an empty one; texts may have any length; nulls in other columns stay as they
are.  A null or empty text has no letter, so the first stage rejects it; called on its own, the quality stage rejects it
too, the near-duplicate and secret stages keep it as it is, and packing gives it the end id alone.  Rows with a null id are never
near duplicates.  Of rows with one id and one text the first one by its JSON text stays; rows with one id and different
texts share their document's fate.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrium.llm import language_id, near_dedup, packing, resampling, secrets
from atrium.llm.common import documents, kept

#: A text whose best language is less likely than this is rejected, and so is one with no letter.
LEAST_LIKELY = 0.5


def _aside(docs: DataFrame) -> DataFrame:
    """doc_id and text beside a struct of all other columns, so that no name of theirs meets an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("row"), "doc_id", "text")


def _back(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return df.select(*[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts in no learned language."""
    network = language_id.fit(docs, ~language_id.held_out())
    if network is None:  # nothing to learn from: only letters decide
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    done = language_id.predict(_aside(docs), network, more=["row", "text"])
    return _back(done.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LIKELY)), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling draws."""
    return _back(resampling.resample(_aside(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("_kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group; documents without an id stay."""
    chosen = near_dedup.near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    stay = docs.join(chosen, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    if not docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        first = stay.groupBy("doc_id", "text").agg(F.min_by(row.alias("row"), F.to_json(row)).alias("row"))
        stay = first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return stay.union(docs.filter("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return _back(secrets.redacted(_aside(docs), secrets.fit(docs)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True)


STAGES = [("language_id", language), ("quality", quality), ("near_dedup", near_duplicates), ("secrets", secret_scan), ("packing", pack)]
#: SQL cannot express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
