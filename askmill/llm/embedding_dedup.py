"""Near-duplicate vectors by collision-counting projections.

Unit vectors are projected on ``PROJECTIONS`` random directions. Two vectors
collide on a direction if one lies in the window around the other's projection.
Pairs at the similarity threshold collide on most directions; how many is
calibrated, by simulated pairs at the threshold, so that the share ``recall`` of
them passes. Pairs that pass are compared in double precision.

Equal vectors of a group are one class with a count. Classes are sorted by group
and first projection and cut into blocks; only blocks whose ranges come within a
window meet. A task counts the collisions of two blocks in memory, and emits a
count of links and a component for each vector, never the pairs. Work within a
group grows with the pairs of blocks that meet.

A vector that is null, empty, all zero or holds a null or a number that is not
finite is linked with nothing, nor is one without a group; vectors of different
lengths are never linked. Repeated rows are vectors of their own: they link with
each other. A row with a null id counts in others' links, and its own component
is null. An empty table gives an empty table. Only the id, vector and group
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.llm.components import components
from askmill.session import materialise

PROJECTIONS = 64
#: Directions counted first, for all pairs; the rest only for pairs that pass.
FIRST = 16
#: Half the window, in standard deviations of the difference of a pair at the threshold.
WINDOW = 2.0
#: The window of the projection that blocks are sorted by is so much wider, since a pair outside it is lost.
LEAD_WINDOWS = 2.0
#: Pairs at the threshold that pass each of the two counts.
RECALL = 0.9995
#: Vectors of a block.
BLOCK = 1024
_SIMULATED = 40_000


class Collisions:
    """Directions for vectors of one length, and the counts that pairs at the threshold reach."""

    def __init__(self, length: int, threshold: float, recall: float = RECALL) -> None:
        random = np.random.default_rng(length)
        self.directions = random.standard_normal((length, PROJECTIONS)).astype(np.float32)
        self.half = np.float32(WINDOW * np.sqrt(max(0.0, 2 - 2 * threshold)))
        one = random.standard_normal((_SIMULATED, length))
        one /= np.linalg.norm(one, axis=1, keepdims=True)
        away = random.standard_normal((_SIMULATED, length))
        away -= (away * one).sum(axis=1, keepdims=True) * one
        size = np.linalg.norm(away, axis=1, keepdims=True)
        other = threshold * one + np.sqrt(max(0.0, 1 - threshold**2)) * away / np.where(size > 0, size, 1)
        near = np.abs((one - other).astype(np.float32) @ self.directions) <= self.half
        self.least_first = int(np.quantile(near[:, :FIRST].sum(axis=1), 1 - recall, method="lower"))
        self.least = int(np.quantile(near.sum(axis=1), 1 - recall, method="lower"))

    def project(self, units: np.ndarray) -> np.ndarray:
        return units.astype(np.float32) @ self.directions

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of two blocks of projections that collide often enough."""
        count = np.zeros((len(left), len(right)), dtype=np.uint8)
        for j in range(FIRST):
            count += np.abs(left[:, j, None] - right[None, :, j]) <= self.half
        p, q = np.nonzero(count >= self.least_first)
        total = count[p, q] + (np.abs(left[p, FIRST:] - right[q, FIRST:]) <= self.half).sum(axis=1)
        keep = total >= self.least
        return p[keep], q[keep]


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


_known: dict[tuple, Collisions] = {}


def _collisions(length: int, threshold: float) -> Collisions:
    key = (length, threshold)
    if key not in _known:
        _known[key] = Collisions(length, threshold)
    return _known[key]


_BLOCKS = "grp bigint, length int, block bigint, lo float, hi float, ids array<bigint>, copies array<bigint>, vectors binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, held = TaskContext.get().partitionId(), 0, []

    def flush() -> pa.RecordBatch:
        nonlocal number
        number += 1
        row = [held[0][0], held[0][1], (part << 32) + number, held[0][2], held[-1][2]]
        row += [[r[3] for r in held], [r[4] for r in held], np.array([r[5] for r in held], dtype="<f8").tobytes()]
        longs = pa.list_(pa.int64())
        types = [pa.int64(), pa.int32(), pa.int64(), pa.float32(), pa.float32(), longs, longs, pa.binary()]
        names = ["grp", "length", "block", "lo", "hi", "ids", "copies", "vectors"]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if held and (row[:2] != held[0][:2] or len(held) == BLOCK):
                yield flush()
                held = []
            held.append(row)
    if held:
        yield flush()


def _forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least row of each row's component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, p, label[q])
        np.minimum.at(label, q, label[p])
        label = label[label]
        if np.array_equal(label, before):
            return label


def _link(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, same, ids, copies, vectors, ids2, copies2, vectors2 in zip(*(c.to_pylist() for c in batch.columns)):
                known = _collisions(length, threshold)
                a = _units(np.frombuffer(vectors, dtype="<f8").reshape(-1, length))
                b = a if same else _units(np.frombuffer(vectors2, dtype="<f8").reshape(-1, length))
                p, q = known.pairs(known.project(a), known.project(b))
                if same:
                    p, q = p[p < q], q[p < q]
                near = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
                p, q = p[near], q[near]
                node, weight = np.array(ids), np.array(copies)
                if not same:
                    node, weight, q = np.concatenate([node, ids2]), np.concatenate([weight, copies2]), q + len(a)
                links = np.bincount(p, weights=weight[q], minlength=len(node)) + np.bincount(q, weights=weight[p], minlength=len(node))
                least = _forest(len(node), p, q)
                linked = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[linked]), pa.array(links[linked].astype(np.int64)), pa.array(node[least[linked]])],
                    names=["u", "n", "v"],
                )

    return run


def near_vectors(
    df: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", group: str = "label"
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: links have a cosine of ``threshold`` or more within a group.

    ``group`` is an integer column.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    numbers = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{group}`").cast("bigint").alias("grp"), numbers.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("grp").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    # A vector that takes no part has no key and so joins with nothing.
    keyed = rows.withColumn("vector", F.when(sound, F.col("vector"))).withColumn("key", F.xxhash64("vector"))
    own = ["grp", "key", "vector"]
    classes = keyed.where(F.col("vector").isNotNull()).groupBy(*own).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    classes = materialise(classes.withColumn("node", F.coalesce("node", F.lit(-(1 << 62)) + F.pmod("key", F.lit(1 << 61)))), "classes")
    first = _lead(classes, threshold)
    ordered = first.repartitionByRange("grp", "length", "lead", "node").sortWithinPartitions("grp", "length", "lead", "node")
    blocks = materialise(ordered.select("grp", "length", "lead", "node", "copies", "vector").mapInArrow(_blocks, _BLOCKS), "blocks")
    half = float(WINDOW * np.sqrt(max(0.0, 2 - 2 * threshold))) * LEAD_WINDOWS
    a, b = blocks.alias("a"), blocks.alias("b")
    meets = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("grp", "length")]
    meets += [F.col("a.block") <= F.col("b.block"), F.col("b.lo") <= F.col("a.hi") + half]
    same = F.col("a.block") == F.col("b.block")
    cells = a.join(b, meets).select(
        "a.length", same.alias("same"), *[f"a.{c}" for c in ("ids", "copies", "vectors")], *[F.when(~same, F.col(f"b.{c}")).alias(f"{c}2") for c in ("ids", "copies", "vectors")]
    )
    links = materialise(cells.mapInArrow(_link(threshold), "u bigint, n bigint, v bigint"), "vector-links")
    counts = links.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    placed = keyed.join(classes, own, "left").join(counts, "node", "left").join(components(links.select("u", "v")), "node", "left")
    n_links = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "node", "vec_id"))
    return placed.select("vec_id", n_links.alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


def _lead(classes: DataFrame, threshold: float) -> DataFrame:
    """Append the length of each vector and its first projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            leads = [float(v @ _collisions(len(v), threshold).directions[:, 0]) for v in (x / np.linalg.norm(x) for x in map(np.asarray, vectors))]
            arrays = [*(batch.column(c) for c in ("grp", "vector", "node", "copies")), pa.array([len(v) for v in vectors], pa.int32()), pa.array(leads, pa.float32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["grp", "vector", "node", "copies", "length", "lead"])

    schema = "grp bigint, vector array<double>, node bigint, copies bigint, length int, lead float"
    return classes.select("grp", "vector", "node", "copies").mapInArrow(run, schema)
