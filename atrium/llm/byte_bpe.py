"""Operator 1: byte-level BPE encoding and decoding of a text column.

Null text counts as empty and gives no tokens.  Every row of the input gives one row, repeated rows too; an empty table gives none;
nothing is shuffled.  A text may have any length: a task holds one text and its ids, and pieces of megabytes go through the
transducer in parts.  Only the id column and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atrium.llm.bpe_transducer import Transducer
from atrium.llm.chunks import SpacedEncoder
from atrium.llm.common import short_batches
from atrium.llm.library_tokens import BYTE_LEVEL, STOPS

_MADE: dict[str, tuple] = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base 64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def codec(ranks_file: bytes, pattern: str) -> tuple[SpacedEncoder, Transducer]:
    """Text -> ids as little-endian 32-bit bytes, and the transducer that decodes them; one for each process."""
    key = hashlib.md5(ranks_file + pattern.encode()).hexdigest()
    if key not in _MADE:
        machine, split = Transducer(read_ranks(ranks_file)), regex.compile(pattern)

        words = pattern == BYTE_LEVEL  # the pattern under which a word and the sign after it are two pieces

        def encode(text: str) -> bytes:
            body = text[1:] if text[0] == " " else text
            if not body.isalpha():
                if words and body[-1:] in STOPS and body[:-1].isalpha():
                    return (made.bare if body is text else made.spaced)[body[:-1]] + made.bare[body[-1]]
                pieces = split.findall(text)
                if len(pieces) > 1:
                    return b"".join(made.spaced[p[1:]] if p[0] == " " and len(p) > 1 else made.bare[p] for p in pieces)
            return array("I", machine.encode(text.encode("utf-8", "replace"))).tobytes()

        made = SpacedEncoder(encode, encode)
        _MADE[key] = made, machine
    return _MADE[key]


def encode_column(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encodes ``text_col`` and decodes the ids again.

    Returns ``id_col``, ``n_tokens`` and ``ids`` (array of int) and ``decoded`` (text); with ``digests``
    the two last give way to ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256``.
    """
    spark = df.sparkSession
    short_batches(spark)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary file: a fixed size, under a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, machine = codec(ranks.value, pattern)
        decimal = [str(i) for i in range(max(machine.bytes_of, default=0) + 1)].__getitem__
        for batch in batches:
            counts, first, second = [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(encode(text or ""), "<u4").tolist()
                decoded = machine.decode(ids)
                counts.append(len(ids))
                if digests:
                    first.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                    second.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    first.append(ids)
                    second.append(decoded)
            kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], names=names)

    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = [df.schema[id_col].dataType, T.LongType(), T.StringType() if digests else T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(names, kinds, strict=True)])
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)
