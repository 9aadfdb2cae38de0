"""What the operators share: the shared scratch folder, kept tables and batch sizes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch that goes to Python.  Texts may have megabytes each, so batches stay short.
BATCH_ROWS = 256


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent and Spark runs in one process (as in tests) a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-atrium-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame, options: dict | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batch size to ``rows`` where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(df: DataFrame, rows_each: int) -> int:
    """How many partitions hold the rows of ``df`` with about ``rows_each`` in each."""
    return max(1, -(-df.select(F.lit(1)).count() // rows_each))


def smallest(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows of smallest ``key`` (a hash).  The bar is found on the keys alone, so that only rows under it travel whole."""
    bar = df.select(key).orderBy(key).limit(rows).agg(F.max(key)).first()[0]
    return df.filter(F.col(key) <= F.lit(bar)).orderBy(key).limit(rows)
