"""Operator 9: media columns in GIF.

``write_media`` stores each text's bytes as 8-bit samples of a grey-scale GIF, 64 samples to a row, in
frames of at most 4,096 rows shown one after another; ``read_media`` decodes stored images of any kind into timed
frames with colour histograms.  Both are maps over rows: nothing is shuffled, and one row's image is the
largest thing that a task holds.

Defined cases: null text is empty; the payload is never empty (zero bytes fill it up to a multiple of 64); equal texts, and repeated
rows, have equal images; texts of any length are cut into frames of 256 kB, and frames are decoded one at a time; stored data
that is cut or broken gives the frames before the break, and null or other data none; an empty table gives no row; only the id
and the text are read, whatever the names of other columns.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atrium.llm import gif
from atrium.llm.common import kept, short_batches

WIDTH = 64
ROWS = 4096


def to_gif(payload: bytes) -> bytes:
    size = WIDTH * ROWS
    return gif.write([(payload[i : i + size], len(payload[i : i + size]) // WIDTH) for i in range(0, len(payload), size)], WIDTH)


def payload_of(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def write_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the stored images, written into the shared folder and read back."""
    short_batches(df.sparkSession)
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([to_gif(payload_of(d)) for d in data], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return kept(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema), {"compression": "none"})


def read_media(media: DataFrame) -> DataFrame:
    """One row per frame of the column ``media``: doc_id, frame, at_ms, for_ms, width, height, red, green, blue (16-step histograms)."""
    names = ["doc_id", "frame", "at_ms", "for_ms", "width", "height", "red", "green", "blue"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, f in enumerate(gif.frames(data or b"")):
                    h = f.histogram()
                    rows.append((i, k, f.at_ms, f.for_ms, f.width, f.height, h[:16], h[16:32], h[32:]))
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            types = [batch.schema.field(0).type, *[pa.int32()] * 5, *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    kinds = [media.schema["doc_id"].dataType, *[T.IntegerType()] * 5, *[T.ArrayType(T.LongType())] * 3]
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(names, kinds, strict=True)])
    return media.select("doc_id", "media").mapInArrow(run, schema)


def media_digests(df: DataFrame) -> DataFrame:
    """What the stored images hold: the contract's row for each document, with its timed frames and colour histograms."""
    media = write_media(df)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frame_at_ms", "frame_for_ms", "red", "green", "blue"]
    kinds = [media.schema["doc_id"].dataType, T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), *[T.ArrayType(T.LongType())] * 5]
    lists = [pa.list_(pa.int64())] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                digest, size, tail, counts, at, long = hashlib.sha256(), 0, b"", np.zeros(48, "int64"), [], []
                for f in gif.frames(data):
                    part = f.box()[..., 0].tobytes()
                    digest.update(part)
                    size, tail = size + len(part), (tail + part)[-64:]
                    counts += f.histogram()
                    at.append(f.at_ms)
                    long.append(f.for_ms)
                feature = f"frames={len(at)};ms={sum(long)};rgb16=" + ",".join(map(str, counts))
                rows.append((size, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature, at, long, *(counts[i : i + 16] for i in (0, 16, 32))))
            columns = list(zip(*rows, strict=True)) or [[] for _ in names[2:]]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], names=names)

    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(names, kinds, strict=True)])
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
