"""Operator 7: token ids as Parquet list columns that can be read in part.

``write_tokens`` puts the documents in ascending id order into files of bounded size.  Row groups and
pages are small, so the column index of ``doc_id`` lets a reader of a few documents skip the rest, and a
reader of metadata never touches the ids.  ``ids`` is dictionary-encoded; the id and offset columns are
delta-encoded.  The order is made by one range exchange; offsets inside a file are counted while it is
written and the files' own offsets come from one row for each file.

Defined cases: null and empty texts are the end id alone; rows with equal ids are ordered by a hash of their text and null ids
come first; repeated rows are stored as often; a text of any length is one list (a task holds one batch of lists); an empty table
gives no row; only the id and the text are read, whatever the names of other columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from atrium.llm.common import kept, scratch, short_batches
from atrium.llm.library_tokens import encoder, read_tokenizer

def _schema(kind: T.DataType) -> T.StructType:
    kinds = {"part": T.IntegerType(), "doc_id": kind, "local_start": T.LongType(), "n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType())}
    return T.StructType([T.StructField(name, k) for name, k in kinds.items()])


#: Parquet writer settings: row groups of 16 MB, pages of 64 kB, delta encodings, no dictionary for the sorted columns.
LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "snappy",
}


def write_tokens(df: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 50_000, words: bool = True) -> None:
    """Encodes ``text_col`` (null: empty), appends ``end_id`` and writes the rows in ascending ``id_col`` order.

    Rows with equal ids are ordered by a hash of their text; null ids come first.
    """
    spark = df.sparkSession
    short_batches(spark)
    model = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))  # a vocabulary file: a fixed size, under 2 MB
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.select(F.lit(1)).count() // rows_per_file))
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model.value, words)
        part, at = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            flat, counts = [], []
            for text in batch.column(1).to_pylist():
                ids = encode(text or "") + end
                flat.append(ids)
                counts.append(len(ids) // 4)
            n = np.array(counts, "int64")
            stop = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, stop], pa.int32()), pa.array(np.frombuffer(b"".join(flat), "<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, "int32")), batch.column(0), pa.array(at + stop - n), pa.array(n), lists], names=["part", "doc_id", "local_start", "n_tokens", "ids"])
            at += int(stop[-1]) if len(n) else 0

    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, _schema(rows.schema["doc_id"].dataType)).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, id_type: T.DataType | str = "long", first: int | None = None, last: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """The table, or only ``columns`` of it, or only the ids from ``first`` to ``last`` (pushed to row groups and pages)."""
    kind = T.DataType.fromDDL(id_type) if isinstance(id_type, str) else id_type
    df = spark.read.schema(_schema(kind)).parquet(path)
    if first is not None:
        df = df.filter(F.col("doc_id") >= first)
    if last is not None:
        df = df.filter(F.col("doc_id") <= last)
    return df.select(*columns) if columns else df


def with_starts(tokens: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """Adds ``start``: the ids of all documents before.

    The files' own offsets are one row for each file; up to ``most_broadcast`` files (a few megabytes) they
    are broadcast, so the ids stay where they are.
    """
    each = kept(tokens.groupBy("part").agg(F.sum("n_tokens").alias("in_part")))
    base = each.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("base"))
    base = F.broadcast(base) if each.count() <= most_broadcast else base
    return tokens.join(base, "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what is stored."""
    kinds = [tokens.schema["doc_id"].dataType, *[T.LongType()] * 3]
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(("doc_id", "start", "n_tokens", "ids_crc32"), kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, sums = batch.column(2), [], []
            values = ids.values.to_numpy().astype("<u4", copy=False)
            for a, b in zip(ids.offsets.to_numpy()[:-1], ids.offsets.to_numpy()[1:], strict=True):
                counts.append(b - a)
                sums.append(zlib.crc32(values[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, schema)


def token_digests(df: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes the token table into the shared folder, reads it back and gives the digests of what was read."""
    path = scratch(df.sparkSession)
    write_tokens(df, tokenizer_path, end_id, path)
    return digests(with_starts(read_tokens(df.sparkSession, path, df.schema["doc_id"].dataType)))
