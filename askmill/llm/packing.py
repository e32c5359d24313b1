"""Best-fit packing of documents into sequences under several capacities.

A document longer than a sequence is cut into full pieces; its first piece takes
the remainder. Every shorter piece goes, longest first, into the open sequence
that fits it best as a vector: residual tokens, documents and attention cost
(sum of squared piece lengths), each as a share of its capacity. A sequence is
open to a piece only if all three residuals suffice.

Pieces are dealt evenly into groups of bounded size, and each group is packed by
one task, so a group leaves few sequences unfilled. Which texts are equal or
which ids repeat plays no part in the dealing, so no group is hot.

A null text is an empty document, which still has its end id. Rows that share an
id are packed one by one. An empty table gives no pieces. Only the id and text
columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.llm.bpe import WORDS, PieceEncoder
from askmill.session import scratch_path

#: Pieces that one task packs.
GROUP = 16_384
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(
    docs: DataFrame, tokenizer: str, length: int, end_id: int, doc_id: str = "doc_id", text: str = "text", words: int = WORDS
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document with its end id, in pieces of at most ``length`` ids.

    A Python worker remembers the ids of ``words`` words at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(shared.value, words)
        for batch in batches:
            owner, piece, start, size, crc = [], [], [], [], []
            for number, content in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encoder.encode(content) + end
                n = len(ids) // 4
                first = n % length or length
                cuts = [0, *range(first, n + 1, length)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    owner.append(number)
                    piece.append(i)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, size, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    source = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, _PIECES)


def best_fit(lengths: np.ndarray, capacity: int, max_documents: int, max_attention: int, rule: str = "norm", weights=(1.0, 0.05, 0.05)):
    """Sequence and offset of each piece of one group, pieces taken longest first.

    ``rule`` scores the open sequences with room in every dimension; the lowest
    score wins, then the sequence opened first. ``norm`` is the weighted length
    of the residual that would be left, ``dot`` the weighted product of that
    residual with the piece's own demand.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"rule is 'norm' or 'dot', not {rule!r}")
    caps = np.array([capacity, max_documents, max_attention], dtype=np.float64)
    weight = np.asarray(weights, dtype=np.float64)
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    left = np.empty((3, max(n, 1)))
    names = np.empty(max(n, 1), dtype=np.int64)
    shortest, opened, made = int(lengths.min()) if n else 0, 0, 0
    for turn, i in enumerate(order):
        size = int(lengths[i])
        demand = np.array([size, 1, size * size], dtype=np.float64)
        now = left[:, :opened]
        fits = np.flatnonzero((now[0] >= size) & (now[1] >= 1) & (now[2] >= demand[2]))
        if len(fits):
            rest = (now[:, fits] - demand[:, None]) / caps[:, None]
            score = weight @ (rest * rest) if rule == "norm" else (weight * demand / caps) @ rest
            best = fits[int(score.argmin())]
        else:
            best, names[opened] = opened, made
            left[:, opened] = caps
            opened, made = opened + 1, made + 1
        sequence[i], offset[i] = names[best], capacity - int(left[0, best])
        left[:, best] -= demand
        if turn % 256 == 255:
            keep = np.flatnonzero((left[0, :opened] >= shortest) & (left[1, :opened] >= 1) & (left[2, :opened] >= shortest * shortest))
            left[:, : len(keep)], names[: len(keep)], opened = left[:, keep], names[keep], len(keep)
    return sequence, offset


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    max_documents: int = 1024,
    max_attention: int = 1024 * 1024,
    end_id: int = 2,
    rule: str = "norm",
    doc_id: str = "doc_id",
    text: str = "text",
    group: int = GROUP,
    words: int = WORDS,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    Pieces are no longer than the attention capacity allows one piece to be, so
    every piece fits a sequence of its own. With the defaults the capacities for
    documents and attention never bind before the one for tokens does.
    """
    spark = docs.sparkSession
    longest = min(capacity, isqrt(max_attention))
    if longest < 1 or max_documents < 1:
        raise ValueError("every capacity must admit one piece of one token")
    path = scratch_path(spark, "pieces")
    # Tokens are cut once; what follows reads five numbers a piece.
    cut_pieces(docs, tokenizer, longest, end_id, doc_id, text, words).write.parquet(path)
    pieces = spark.read.schema(_PIECES).parquet(path)
    full = F.col("length") == capacity
    groups = max(1, -(-pieces.where(~full).count() // group))
    alone = pieces.where(full).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "length", "ids_crc32"], kind="stable")
        sequence, offset = best_fit(rows["length"].to_numpy(), capacity, max_documents, max_attention, rule)
        return pd.DataFrame(
            {
                **{c: rows[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
                "sequence_id": sequence + (rows["part"].to_numpy().astype(np.int64) << 32),
                "offset": offset,
            }
        )

    dealt = pieces.where(~full).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    return dealt.groupBy("part").applyInPandas(run, f"{_PIECES}, sequence_id bigint, offset bigint").unionByName(alone)
