"""Byte-level BPE encoding and decoding over Arrow batches.

Encoding keeps one row per input row. A null text is an empty one. Repeated
rows and rows with a null id stay. Other columns are passed on, except those
that are named like an output column, which is replaced. An empty table gives
an empty table. Any length of text is encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askmill.llm.bpe import PieceEncoder, byte_table, decode_bytes, read_ranks, tokenizer_json


def load_tokenizer(path: str, pattern: str | None = None) -> str:
    """The JSON of a tokenizer, read by the driver: a ``.json`` file, or a rank file with the pattern that cuts texts."""
    with open(os.fspath(path), "rb") as file:
        content = file.read()
    if path.endswith(".json"):
        return content.decode()
    if pattern is None:
        raise ValueError("a rank file needs the pattern that cuts texts before the merges")
    return tokenizer_json(read_ranks(content), pattern)


def share(spark: SparkSession, tokenizer: str):
    """The tokenizer for all tasks; a vocabulary file is a few megabytes and does not grow with the data."""
    return spark.sparkContext.broadcast(tokenizer)


def with_columns(df: DataFrame, make, fields: list[T.StructField], inputs: list[str]) -> DataFrame:
    """Append columns that ``make`` computes from the Arrow arrays of ``inputs``; columns of the same names are replaced."""
    names = [field.name for field in fields]
    passed = [c for c in df.columns if c not in names]
    source = df.select(*[F.col(f"`{c}`") for c in passed], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([*(df.schema[c] for c in passed), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [batch.column(f"__in{i}") for i in range(len(inputs))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *make(*given)], names=[*passed, *names])

    return source.mapInArrow(run, schema)


def encode(df: DataFrame, tokenizer: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Append ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``.

    With ``offsets`` also ``starts`` and ``ends``: the characters of the text
    that each token covers. Tokens that share a character all cover it.
    """
    shared = share(df.sparkSession, tokenizer)

    def make(texts: pa.Array) -> list[pa.Array]:
        encoder = PieceEncoder.of(shared.value)
        if offsets:
            found = [encoder.tokenizer.encode(t or "", add_special_tokens=False) for t in texts.to_pylist()]
            ids = [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]
            spans = [pa.array([[o[side] for o in e.offsets] for e in found], pa.list_(pa.int32())) for side in (0, 1)]
        else:
            ids, spans = [encoder.encode(t) for t in texts.to_pylist()], []
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), *spans]

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    if offsets:
        fields += [T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("starts", "ends")]
    return with_columns(df, make, fields, [text])


def decode(df: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """Append ``decoded`` (binary). Null ids are none. ``decode_text`` turns the bytes into a text."""
    shared = df.sparkSession.sparkContext.broadcast(byte_table(tokenizer))

    def make(column: pa.Array) -> list[pa.Array]:
        table = shared.value
        return [pa.array([decode_bytes(table, x or b"") for x in column.to_pylist()], pa.binary())]

    return with_columns(df, make, [T.StructField("decoded", T.BinaryType())], [ids])


def decode_text(df: DataFrame, decoded: str = "decoded", text: str = "text") -> DataFrame:
    """The text of decoded bytes; a character cut off at either end becomes the replacement character."""

    def make(column: pa.Array) -> list[pa.Array]:
        return [pa.array([(x or b"").decode("utf-8", "replace") for x in column.to_pylist()], pa.string())]

    return with_columns(df, make, [T.StructField(text, T.StringType())], [decoded])
