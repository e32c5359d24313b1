"""Shards along a Hilbert curve, in built-in functions only.

Several metadata columns are quantised to cells, the cells are numbered along a
Hilbert curve, and the rows in that order are cut into runs of equal length. Rows
that are close in all columns share a shard, so the least and greatest values of
a shard are close as well, and a filter on any of the columns skips most files.

Ranks need no global window: rows are sorted by ranges, a row's place in its
range comes with it, and only the sizes of the ranges are summed up. Equal cells
are ordered by id, then by the place in the input, so a value that a third of
all rows share is spread over as many ranges as it needs.

A null value has a cell of its own, below all others. Repeated rows and null ids
take a slot each. More shards than rows leave shards empty. An empty table gives
an empty table. Columns named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askmill.operators.dimensions import broadcast_if_small
from askmill.session import materialise

#: Bits of each quantised dimension.
BITS = 8


def by_magnitude(value: Column, bits: int = BITS) -> Column:
    """The cell of a number of 0 or more, eight to a doubling; null is 0."""
    most = (1 << bits) - 1
    cell = F.floor(F.log2(F.greatest(value.cast("double"), F.lit(0.0)) + 1) * 8) + 1
    return F.coalesce(F.least(cell, F.lit(most)), F.lit(0)).cast("bigint")


def by_name(value: Column, bits: int = BITS) -> Column:
    """The cell of a name, by its checksum; null is 0."""
    most = (1 << bits) - 1
    return F.coalesce(F.crc32(value.cast("string").cast("binary")) % most + 1, F.lit(0)).cast("bigint")


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The place of a cell along the Hilbert curve through all ``len(cells)`` dimensions of ``bits`` bits.

    Skilling's transform (2004): undo the turns of the curve from the highest
    bit down, take the Gray code, and interleave the bits.
    """
    n = len(cells)
    if n < 2 or n * bits > 62:
        raise ValueError("two or more dimensions of at most 62 bits together")

    def step_list(steps: list[tuple[int, int]]) -> Column:
        return F.array(*[F.struct(F.lit(q).cast("bigint").alias("q"), F.lit(i).alias("i")) for q, i in steps])

    def turn(x: Column, step: Column) -> Column:
        first, own, low = F.get(x, F.lit(0)), F.get(x, step["i"]), step["q"] - 1
        swapped = first.bitwiseXOR(own).bitwiseAND(low)
        is_set = own.bitwiseAND(step["q"]) != 0

        def change(value: Column, place: Column) -> Column:
            flipped = F.when(is_set, value.bitwiseXOR(low)).otherwise(value.bitwiseXOR(swapped))
            return F.when(place == 0, flipped).when((place == step["i"]) & ~is_set, value.bitwiseXOR(swapped)).otherwise(value)

        return F.transform(x, change)

    def gray(x: Column, step: Column) -> Column:
        before = F.get(x, step["i"] - 1)
        return F.transform(x, lambda value, place: F.when(place == step["i"], value.bitwiseXOR(before)).otherwise(value))

    highest = range(bits - 1, 0, -1)
    start = F.array(*[c.cast("bigint") for c in cells])
    turned = F.aggregate(step_list([(1 << b, i) for b in highest for i in range(n)]), start, turn)
    coded = F.aggregate(step_list([(0, i) for i in range(1, n)]), turned, gray)

    def finish(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        flip = F.aggregate(
            F.array(*[F.lit(1 << b).cast("bigint") for b in highest]),
            F.lit(0).cast("bigint"),
            lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
        )
        return F.transform(F.array(flip), lambda t: F.transform(x, lambda value: value.bitwiseXOR(t)))

    final = F.element_at(F.element_at(F.transform(F.array(coded), finish), 1), 1)
    order = step_list([(1 << b, i) for b in range(bits - 1, -1, -1) for i in range(n)])

    def interleave(x: Column) -> Column:
        return F.aggregate(
            order,
            F.lit(0).cast("bigint"),
            lambda code, s: code * 2 + F.when(F.get(x, s["i"]).bitwiseAND(s["q"]) != 0, F.lit(1)).otherwise(F.lit(0)),
        )

    return F.element_at(F.transform(F.array(final), interleave), 1)


def assign_shards(df: DataFrame, cells: list[Column], shards: int, doc_id: str = "doc_id", bits: int = BITS) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: counts of shards differ by one at most, slots have no gaps.

    All columns are shuffled once; pass only those that the result needs.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    passed = [c for c in df.columns if c not in ("shard", "slot")]
    placed = df.select(
        *[F.col(f"`{c}`") for c in passed], hilbert_index(cells, bits).alias("__curve"), F.monotonically_increasing_id().alias("__input")
    )
    keys = ["__curve", f"`{doc_id}`", "__input"]
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The id of a row holds its range in the upper bits and its place there in the lower 33.
    stored = materialise(ordered.withColumn("__place", F.monotonically_increasing_id()), "curve")
    part = F.shiftright("__place", 33)
    sizes = stored.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    # One row a range: as many as the sort had tasks.
    earlier = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    base = sizes.select("__part", F.coalesce(earlier, F.lit(0)).alias("__before"), total.alias("__n"))
    joined = stored.withColumn("__part", part).join(broadcast_if_small(base), "__part")
    rank = F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1)
    ranked = joined.withColumn("__rank", rank).withColumn("shard", F.expr(f"int(__rank * {shards} div __n)"))
    slot = F.expr(f"__rank - (shard * __n + {shards - 1}) div {shards}")
    return ranked.select(*[F.col(f"`{c}`") for c in passed], "shard", slot.alias("slot"))


def write_shards(assigned: DataFrame, path: str, stats: list[str]) -> None:
    """Write one folder a shard, rows in order of their slots, and a ``manifest`` with the range of each of ``stats``."""
    assigned.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{path}/shards")
    ranges = [f(F.col(f"`{c}`")).alias(f"{name}_{c}") for c in stats for f, name in ((F.min, "min"), (F.max, "max"))]
    assigned.groupBy("shard").agg(F.count("*").alias("n"), *ranges).coalesce(1).write.parquet(f"{path}/manifest")
