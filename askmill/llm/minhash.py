"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of word shingles, hashed to 64 bits. ``bands * rows``
   minima are taken; bands of ``rows`` whole minima give candidate keys, the low
   ``BITS`` bits of all minima are packed into the signature.
2. Documents with equal sets are one class; only its representative goes on.
3. Representatives that share a band key are candidates. Each is first paired with
   one other only, the least document of most of its keys. The bit counts of two
   signatures give the share of equal minima; corrected for chance agreement of
   low bits it estimates the similarity, and pairs five deviations below the
   threshold are left. All others are compared on their full sets.
4. A key whose documents are then still in several components is searched again,
   in cells of bounded size, for pairs across components. Rows of a cell that
   take part in such a pair get their full sets, and the task compares them all,
   skipping pairs that are linked by then. Only links between components leave
   it, fewer than the cell has rows: pairs never become rows, however many of
   them are likely but no links.

The probability that a pair at similarity 0.8 shares no key is below 1e-5 with
the default 32 bands of 5 rows.

A null or wordless text has an empty set and is linked with nothing. Rows that
share an id count as one document, linked with whatever any of its texts is
linked with; all of them stay rows of the result. A null id has a null component
and is kept. An empty table gives an empty table. Only the id and text columns
are read. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askmill.llm import remembered
from askmill.llm.components import stars
from askmill.operators.dimensions import broadcast_if_small
from askmill.session import materialise

BITS = 4
#: Rows of a cell, the unit in which large keys are searched.
CELL = 512
#: Documents that each is first compared with, of the least documents of its keys.
FIRST_TRIES = 1
#: Pairs whose keys are compared at a time, and rows of a batch that searched cells hand on.
PAIRS, ROWS = 16_384, 10_000
_LIKELY = "key bigint, i bigint, j bigint, node bigint, first bigint, half bigint"
_WORDS = 300_000
_SIGNED = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature array<bigint>, keys array<bigint>"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text is one shingle."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    n = max(1, len(found) - words + 1)
    joined = np.zeros(n, dtype=np.uint64)
    for i in range(min(words, len(found))):
        joined = _mix(joined + hashes[i : i + n] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(joined)


class MinHasher:
    """Minima under ``bands * rows`` hash functions, in blocks of shingles."""

    def __init__(self, bands: int, rows: int) -> None:
        if bands * rows % (64 // BITS):
            raise ValueError(f"bands * rows must be a multiple of {64 // BITS}")
        random = np.random.default_rng(20_240_229)
        self.factor = (random.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1))[:, None]
        self.offset = random.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]
        self.bands, self.rows = bands, rows

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        least = None
        for at in range(0, len(low), 2048):
            values = self.factor * low[at : at + 2048]
            values += self.offset
            block = values.min(axis=1)
            least = block if least is None else np.minimum(least, block)
        return least

    def keys(self, minima: np.ndarray) -> np.ndarray:
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in minima.reshape(self.bands, self.rows).T:
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
        return key.view(np.int64)

    def signature(self, minima: np.ndarray) -> np.ndarray:
        low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
        places = np.arange(0, 64, BITS, dtype=np.uint64)
        return np.bitwise_or.reduce(low << places, axis=1).view(np.int64)


def _sign(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered.only("minhash", _hashes.clear)
        hasher = MinHasher(bands, rows)
        for batch in batches:
            out = [[], [], [], [], []]
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, words)
                if len(found):
                    minima = hasher.minima(found)
                    sums = [_mix(found).sum(), _mix(found ^ np.uint64(0xD6E8FEB86659FD93)).sum()]
                    a, b = np.array(sums, dtype=np.uint64).view(np.int64).tolist()
                    row = [len(found), a, b, hasher.signature(minima), hasher.keys(minima)]
                else:
                    row = [0, None, None, None, None]
                for column, value in zip(out, row):
                    column.append(value)
            longs = pa.list_(pa.int64())
            types = [pa.int64(), pa.int64(), pa.int64(), longs, longs]
            names = ["doc_id", "n_shingles", "set_a", "set_b", "signature", "keys"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types))], names=names)

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered.only("minhash", _hashes.clear)
        for batch in batches:
            found = [shingle_set(text, words).view(np.int64) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def least_estimate(threshold: float, hashes: int) -> float:
    """The estimate under which a pair at the threshold falls with a chance of about 3e-7."""
    chance = 2.0**-BITS
    equal = chance + (1 - chance) * threshold
    return threshold - 5 * sqrt(equal * (1 - equal) / hashes) / (1 - chance)


def estimate(a: str, b: str, hashes: int):
    """The collision-corrected similarity of two packed signature columns, by bit counts."""
    lowest = sum(1 << i for i in range(0, 64, BITS))

    def unequal(x, y):
        z = x.bitwiseXOR(y)
        folded = z
        for shift in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(folded.bitwiseAND(F.lit(lowest)))

    differing = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, n: s + n)
    chance = 2.0**-BITS
    return (1 - differing / hashes - chance) / (1 - chance)


def _differing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Unequal minima of each row of ``left`` with each of ``right``."""
    lowest = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    total = np.zeros((len(left), len(right)), dtype=np.int32)
    for a, b in zip(left.T, right.T):
        z = a[:, None] ^ b[None, :]
        folded = z.copy()
        for shift in range(1, BITS):
            folded |= z >> np.uint64(shift)
        total += np.bitwise_count(folded & lowest)
    return total


def _each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, of batches sorted by ``key, i, j``."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        places = [np.asarray(batch.column(name)) for name in ("key", "i", "j")]
        edges = [0, *(np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in places])) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            cell = tuple(int(x[start]) for x in places)
            if held and cell != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = cell
    if held:
        yield pa.Table.from_batches(held)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of many small batches in a few larger ones."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _values(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and the length of each list."""
    lists = column.combine_chunks()
    return np.asarray(lists.flatten()), np.asarray(lists.value_lengths(), dtype=np.int64)


def _sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows on both sides of a cell, and whether the sides are the same."""
    i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
    if i == j:
        return np.arange(cell.num_rows), np.arange(cell.num_rows), True
    half = np.asarray(cell.column("half"))
    return np.flatnonzero(half == i), np.flatnonzero(half == j), False


def _likely_rows(cut: float, hashes: int):
    """The rows of each cell that are in a likely pair across components; a pair counts in the first of its common keys."""
    most = hashes * (1 - 2.0**-BITS) * (1 - cut)

    def rows(cell: pa.Table) -> pa.RecordBatch:
        first, (left, right, _) = np.asarray(cell.column("first")), _sides(cell)
        packed, keys = (_values(cell.column(name))[0].reshape(cell.num_rows, -1) for name in ("signature", "keys"))
        packed, key = packed.view(np.uint64), cell.column("key")[0].as_py()
        likely = (_differing(packed[left], packed[right]) <= most) & (first[left][:, None] != first[right][None, :])
        p, q = np.nonzero(likely)
        p, q, found = left[p], right[q], np.zeros(cell.num_rows, dtype=bool)
        for at in range(0, len(p), PAIRS):
            a, b = p[at : at + PAIRS], q[at : at + PAIRS]
            here = keys[a, (keys[a] == keys[b]).argmax(axis=1)] == key
            found[a[here]] = found[b[here]] = True
        taken = cell.select(["key", "i", "j", "node", "first", "half"]).filter(pa.array(found)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in taken.columns], names=taken.column_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered(map(rows, _each_cell(batches)))

    return run


def _links(percent: int):
    """Links that join components in each cell, by the full sets of its rows: no more than it has rows."""

    def links(cell: pa.Table) -> pa.RecordBatch:
        node, (left, right, inside) = np.asarray(cell.column("node")), _sides(cell)
        values, sizes = _values(cell.column("shingles"))
        shingles = np.unique(values, return_inverse=True)[1]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        component = np.asarray(cell.column("first")).copy()
        marked = np.zeros(len(values), dtype=np.int32)
        u, v = [], []
        for p in left:
            apart = right[(component[right] != component[p]) & (not inside or right > p)]
            if not len(apart):
                continue
            own = shingles[starts[p] : ends[p]]
            marked[own] = 1
            common = np.add.reduceat(marked[shingles], starts)[apart].astype(np.int64)
            marked[own] = 0
            for q in apart[common * 100 >= (sizes[p] + sizes[apart] - common) * percent]:
                if component[q] != component[p]:
                    u.append(int(node[p]))
                    v.append(int(node[q]))
                    component[component == component[q]] = component[p]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered(map(links, _each_cell(batches)))

    return run


class _Linker:
    """Verified links so far, as stars."""

    def __init__(self, source: DataFrame, words: int, percent: int) -> None:
        self.source, self.words, self.percent = source, words, percent
        self.spark: SparkSession = source.sparkSession
        # The constant filter tells the optimizer that there are none, so joins with them vanish.
        self.links = self.spark.createDataFrame([], "u bigint, v bigint").where(F.lit(False))

    def label(self, df: DataFrame, node: str, label: str) -> DataFrame:
        """``df`` with the component of its column ``node``."""
        named = self.links.select(F.col("u").alias(node), F.col("v").alias("__least"))
        return df.join(named, node, "left").withColumn(label, F.coalesce("__least", node)).drop("__least")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """The full sets of all documents ``node``, stored."""
        needed = nodes.select(F.col("node").alias("doc_id")).distinct()
        texts = self.source.join(broadcast_if_small(needed, rows=1_000_000), "doc_id", "left_semi")
        return materialise(texts.mapInArrow(_sets(self.words), "node bigint, shingles array<bigint>"), "sets")

    def compare(self, pairs: DataFrame) -> None:
        """Compare the pairs ``(u, v)`` on full sets."""
        sets = self.sets(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))))
        apart = pairs.where("u <> v").distinct()
        one, other = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}")) for n in ("u", "v"))
        both = F.size(F.array_intersect("su", "sv")).cast("bigint")
        joined = apart.join(one, "u").join(other, "v")
        linked = joined.where(both * 100 >= (F.size("su") + F.size("sv") - both) * self.percent).select("u", "v")
        self.add(linked)

    def add(self, links: DataFrame) -> None:
        """Take in verified links."""
        self.links = stars(self.links.unionByName(links))


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``; documents are linked if 100 times the common shingles are ``percent`` times all or more."""
    hashes = bands * rows
    cut = least_estimate(percent / 100, hashes)
    source = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = materialise(source.mapInArrow(_sign(words, bands, rows), _SIGNED), "signed")
    classes = materialise(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("keys").alias("keys")),
        "classes",
    )
    keyed = classes.select(F.explode("keys").alias("key"), "node")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    members = materialise(keyed.join(shared, "key"), "members")
    signatures = classes.select("node", "signature", "keys")
    one, other = (signatures.select(F.col("node").alias(n), F.col("signature").alias(f"s{n}")) for n in ("u", "v"))
    # Of the least documents of its keys, each document is first compared with the one that most keys name.
    named = members.where("node <> least").groupBy("node", "least").agg(F.count("*").alias("n"))
    by_keys = Window.partitionBy("node").orderBy(F.col("n").desc(), "least")
    most = named.withColumn("at", F.row_number().over(by_keys)).where(F.col("at") <= FIRST_TRIES)
    pairs = most.select(F.col("least").alias("u"), F.col("node").alias("v"))
    likely = pairs.join(one, "u").join(other, "v").where(estimate("su", "sv", hashes) >= cut).select("u", "v")
    likely = materialise(likely, "likely")
    linker = _Linker(source, words, percent)
    linker.compare(likely)
    _search_keys(linker, members, signatures, cut, hashes)
    placed = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(
        classes.select("set_a", "set_b", "node"), ["set_a", "set_b"], "left"
    )
    named = linker.label(placed, "node", "component")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _search_keys(linker: _Linker, members: DataFrame, signatures: DataFrame, cut: float, hashes: int) -> None:
    """Compare what :func:`near_duplicates` has left: pairs across components within a key."""
    labelled = linker.label(members, "node", "first")
    mixed = labelled.groupBy("key").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).where("lo < hi").select("key")
    open_keys = materialise(labelled.join(mixed, "key").select("key", "node", "first", "n"), "open")
    if open_keys.isEmpty():
        return
    halves = F.ceil(F.col("n") / CELL)
    dealt = open_keys.withColumn("halves", halves).withColumn("half", F.pmod(F.xxhash64("node"), "halves"))
    # Row i meets all halves: as the left one from its own on, as the right one before it.
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("halves") - 1))).select(
        "key", F.least("half", "other").alias("i"), F.greatest("half", "other").alias("j"), "node", "first", "half"
    )
    ordered = cells.join(signatures, "node").select("key", "i", "j", "node", "first", "half", "signature", "keys")
    searched = ordered.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    rows = materialise(searched.mapInArrow(_likely_rows(cut, hashes), _LIKELY), "likely-rows")
    if rows.isEmpty():
        return
    with_sets = rows.join(linker.sets(rows), "node").select("key", "i", "j", "node", "first", "half", "shingles")
    compared = with_sets.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    linker.add(materialise(compared.mapInArrow(_links(linker.percent), "u bigint, v bigint"), "found"))
