"""Token files: ids under one canonical, length-limited Huffman code.

``write_token_files`` stores, under ``path``,

* ``codebook``: the length of each id's code word, from counts over all rows,
* ``segments``: folders ``part=N`` in the order of the documents. A row is a run
  of whole documents: the coded bits, the bit offset of every 256th id, and the
  ids and lengths of its documents.

The code is canonical, so lengths alone give it back. A checkpoint makes the ids
after it a block that needs nothing before it; all blocks of a segment are
decoded side by side, one table look-up a step.

A null text is an empty document, which still has its end id. Rows with the same
document id all stay, in any order among themselves; null document ids come
first. An empty table gives a file set without segments. Other columns of the
input are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askmill.llm.bpe import PieceEncoder
from askmill.operators.dimensions import broadcast_if_small
from askmill.session import scratch_path

#: Longest code word in bits, at most 27; the decoding table has two to this power entries, of ids below 2**27.
MAX_BITS = 18
#: Ids of a block between two checkpoints.
BLOCK = 256
#: Ids of a segment, unless one document alone has more.
SEGMENT = 1 << 18

_STORED = "part int, seq bigint, at bigint, doc_id bigint, n int, ids binary"
_SEGMENT = (
    "part int, at bigint, n_tokens bigint, bits binary, checkpoints array<int>, doc_ids array<bigint>, lengths array<int>"
)
_DECODED = "part int, at bigint, doc_id bigint, n_tokens bigint, ids binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Code word lengths of least total size under the limit, by package-merge; 0 for ids that never occur."""
    lengths = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids do not fit code words of {max_bits} bits")
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.int64)
    is_coin, level = [], coins
    for bit in range(max_bits):
        if bit:
            pairs = len(level) // 2 * 2
            packages = level[0:pairs:2] + level[1:pairs:2]
            merged = np.concatenate([coins, packages])
            rank = np.argsort(merged, kind="stable")
            level, kind = merged[rank], rank < len(coins)
        else:
            kind = np.ones(len(coins), dtype=bool)
        is_coin.append(kind)
    taken = 2 * len(coins) - 2
    for kind in reversed(is_coin):
        own = int(np.count_nonzero(kind[:taken]))
        lengths[order[:own]] += 1
        taken = 2 * (taken - own)
    return lengths


class Code:
    """The canonical code of given lengths: shorter words first, then smaller ids."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = np.asarray(lengths, dtype=np.int64)
        used = np.flatnonzero(self.lengths)
        self.order = used[np.lexsort((used, self.lengths[used]))]
        size = self.lengths[self.order]
        self.bits = int(size[-1]) if len(size) else 1
        room = np.int64(1) << (self.bits - size)
        first = np.cumsum(room) - room
        self.words = np.zeros(len(self.lengths), dtype=np.uint64)
        self.words[self.order] = (first >> (self.bits - size)).astype(np.uint64)
        self.room = room

    def table(self) -> np.ndarray:
        """For each string of ``bits`` bits the id of the word that starts it, and the word's length in the low five bits."""
        pad = (1 << self.bits) - int(self.room.sum())
        entries = np.repeat(self.order << 5 | self.lengths[self.order], self.room)
        return np.concatenate([entries, np.ones(pad, dtype=np.int64)]).astype(np.uint32)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of the ids, and the bit offset of each block."""
        if not len(ids):
            return b"", np.zeros(0, dtype=np.int32)
        size = self.lengths[ids]
        end = np.cumsum(size)
        start = end - size
        word = start >> 5
        value = self.words[ids] << (64 - (start & 31) - size).astype(np.uint64)
        edge = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        at = word[edge]
        packed = np.zeros(int(end[-1] >> 5) + 2, dtype=np.uint32)
        packed[at] = np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), edge)
        packed[at + 1] |= np.bitwise_or.reduceat(value.astype(np.uint32), edge)
        return packed.astype(">u4").tobytes()[: int(end[-1] + 7) >> 3], start[::BLOCK].astype(np.int32)


def decode_segment(table: np.ndarray, bits: int, payload: bytes, checkpoints, n: int) -> np.ndarray:
    """The ``n`` ids of a segment: a step reads one id of every block."""
    if n == 0:
        return np.zeros(0, dtype="<u4")
    octets = np.frombuffer(payload + bytes(4 + BLOCK * bits // 8 + 8), dtype=np.uint8).astype(np.uint32)
    window = (octets[:-3] << 24) | (octets[1:-2] << 16) | (octets[2:-1] << 8) | octets[3:]
    at = np.array(checkpoints, dtype=np.int64)
    out = np.empty((min(BLOCK, n), len(at)), dtype="<u4")
    shift = np.uint32(32 - bits)
    for step in range(len(out)):
        found = table[(window[at >> 3] << (at & 7).astype(np.uint32)) >> shift]
        out[step] = found
        at += found & 31
    out >>= 5
    # Only the last block may be short.
    return out.T.reshape(-1)[:n] if len(out) == BLOCK else out[:, 0][:n]


def _tokenise(shared, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, at = PieceEncoder.of(shared.value), TaskContext.get().partitionId(), 0, 0
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids = [encoder.encode(text) + end for text in batch.column("text").to_pylist()]
            size = np.asarray([len(x) // 4 for x in ids], dtype=np.int64)
            rows = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows, part, dtype=np.int32)),
                    pa.array(np.arange(seq, seq + rows)),
                    pa.array(at + np.cumsum(size) - size),
                    batch.column("doc_id"),
                    pa.array(size.astype(np.int32)),
                    pa.array([_narrow(x) for x in ids], pa.binary()),
                ],
                names=["part", "seq", "at", "doc_id", "n", "ids"],
            )
            seq, at = seq + rows, at + int(size.sum())

    return run


def _narrow(ids: bytes) -> bytes:
    """Two bytes an id where all fit, marked by the first byte."""
    wide = np.frombuffer(ids, dtype="<u4")
    return b"\2" + wide.astype("<u2").tobytes() if wide.max(initial=0) < 1 << 16 else b"\4" + ids


def _wide(stored: list[bytes]) -> np.ndarray:
    """The ids of all rows, one after the other."""
    if all(x[:1] == b"\2" for x in stored):
        return np.frombuffer(b"".join([x[1:] for x in stored]), dtype="<u2").astype(np.int64)
    return np.concatenate([np.frombuffer(x, dtype="<u2" if x[:1] == b"\2" else "<u4", offset=1) for x in stored]).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        stored = batch.column("ids").to_pylist()
        for mark, kind in ((b"\2", "<u2"), (b"\4", "<u4")):
            joined = b"".join([x[1:] for x in stored if x[:1] == mark])
            seen = np.bincount(np.frombuffer(joined, dtype=kind), minlength=len(total))
            seen[: len(total)] += total
            total = seen
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


def _segments(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, held, size, following = Code(shared.value), [], 0, None

        def flush() -> pa.RecordBatch:
            ids = _wide([row[5] for row in held])
            bits, checkpoints = code.encode(ids)
            row = [held[0][0], held[0][2], len(ids), bits, checkpoints.tolist(), [r[3] for r in held], [r[4] for r in held]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            names = ["part", "at", "n_tokens", "bits", "checkpoints", "doc_ids", "lengths"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and (row[:2] != following or size + row[4] > SEGMENT):
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size, following = size + row[4], (row[0], row[1] + 1)
        if held:
            yield flush()

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS
) -> None:
    """Encode all texts, each with ``end_id`` appended, and write them in ascending order of their ids.

    Texts are shuffled once, by ranges of their ids. Their ids are stored before
    they are counted, since the code needs the counts of all of them.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer)
    source = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # The last key spreads rows that share an id over several ranges.
    ordered = source.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange("doc_id", "spread")
    stored = scratch_path(spark, "token-ids")
    (
        ordered.sortWithinPartitions("doc_id", "spread")
        .select("doc_id", "text")
        .mapInArrow(_tokenise(shared, end_id), _STORED)
        .write.option("compression", "zstd")
        .parquet(stored)
    )
    ids = spark.read.schema(_STORED).parquet(stored)
    counted = ids.select("ids").mapInArrow(_counts, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    # One row for each id of the vocabulary, however many documents there are.
    found = counted.toArrow()
    counts = np.zeros(max(found.column("id").to_pylist(), default=0) + 1, dtype=np.int64)
    counts[np.asarray(found.column("id"))] = np.asarray(found.column("n"))
    lengths = code_lengths(counts, max_bits)
    used = np.flatnonzero(lengths)
    book = [(int(i), int(lengths[i])) for i in used]
    spark.createDataFrame(book, "id bigint, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    coded = ids.mapInArrow(_segments(spark.sparkContext.broadcast(lengths)), _SEGMENT)
    coded.sortWithinPartitions("part", "at").write.option("compression", "none").partitionBy("part").parquet(f"{path}/segments")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)``: ``start`` counts the ids of all documents before; ``ids`` is little-endian, 32 bits each."""
    book = spark.read.parquet(f"{path}/codebook").toArrow()
    lengths = np.zeros(max(book.column("id").to_pylist(), default=0) + 1, dtype=np.int64)
    lengths[np.asarray(book.column("id"))] = np.asarray(book.column("bits"))
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        table = code.table()
        for batch in batches:
            for part, at, n, bits, checkpoints, docs, sizes in zip(*(column.to_pylist() for column in batch.columns)):
                ids = decode_segment(table, code.bits, bits, checkpoints, n)
                ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
                starts = ends - sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(docs), part, dtype=np.int32)),
                        pa.array(at + starts),
                        pa.array(docs, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    ],
                    names=["part", "at", "doc_id", "n_tokens", "ids"],
                )

    segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments").select(*[x.split()[0] for x in _SEGMENT.split(", ")])
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row a part: as many as the writing job had tasks.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = broadcast_if_small(totals.select(F.col("part"), F.coalesce(before, F.lit(0)).alias("base")))
    decoded = segments.mapInArrow(run, _DECODED).join(base, "part")
    return decoded.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")
