"""Latest observation at or before a point in time, per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askmill.operators.dimensions import broadcast_if_small
from askmill.session import materialise

# Hot keys are broadcast up to this many, if they are small enough as well.
HOT_KEYS = 100_000
# Asks at up to this many moments (key and time) are answered by folding the observations.
FEW_MOMENTS = 64


def _hot_keys(moments: DataFrame, key: str, fits: int) -> DataFrame:
    """Keys with over ``fits`` rows, stored: of N rows in all at most N / ``fits`` keys."""
    counts = moments.groupBy(key).agg(F.count("*").alias("n"))
    return materialise(counts.where(F.col("n") > fits).select(key), "hot-keys")


def _in_one_window(asks: DataFrame, seen: DataFrame, key: str, asked_at: str, value: str) -> DataFrame:
    """Asks and observations on one timeline per key: a single shuffle, and no pairs."""
    columns = asks.columns
    timeline = asks.select(
        key, F.col(asked_at).alias("_at"), F.struct(*[F.col(c) for c in columns]).alias("_ask")
    ).unionByName(seen, allowMissingColumns=True)
    # At equal times observations come first, and of these the greatest value last.
    order = [F.col("_at"), F.col("_ask").isNotNull(), F.col("_held")]
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = timeline.withColumn("_held", F.last("_held", ignorenulls=True).over(so_far))
    return latest.where(F.col("_ask").isNotNull()).select("_ask.*", F.col("_held.value").alias(value))


def _in_ranges(asks: DataFrame, seen: DataFrame, key: str, asked_at: str, value: str) -> DataFrame:
    """The same for keys too large for one task.

    Equal times are folded first, the rest is sorted by ranges of key and time,
    so a key takes as many ranges as it needs, and one row per key and range
    carries the newest observation onwards.
    """
    folded = (
        asks.select(key, F.col(asked_at).alias("_at"), F.lit(True).alias("_wanted"))
        .unionByName(seen, allowMissingColumns=True)
        .groupBy(key, "_at")
        .agg(F.max("_held").alias("_held"), F.max("_wanted").alias("_wanted"))
    )
    # The upper bits of a row's number are its range. Stored, so that all readers see the same ranges.
    placed = folded.repartitionByRange(key, "_at").withColumn("_range", F.shiftright(F.monotonically_increasing_id(), 33))
    timeline = materialise(placed, "timeline")
    so_far = Window.partitionBy(key, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = timeline.withColumn("_held", F.last("_held", ignorenulls=True).over(so_far)).where("_wanted")
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        timeline.groupBy(key, "_range")
        .agg(F.max(F.when(F.col("_held").isNotNull(), F.struct("_at", "_held"))).alias("_newest"))
        .select(key, "_range", F.last(F.col("_newest._held"), ignorenulls=True).over(earlier).alias("_carried"))
    )
    resolved = within.join(carried, [key, "_range"], "left").select(
        key, F.col("_at").alias(asked_at), F.coalesce("_held", "_carried")["value"].alias(value)
    )
    return asks.join(resolved, [key, asked_at], "left").select(*asks.columns, value)


def _few_moments(asks: DataFrame, key: str, asked_at: str) -> DataFrame | None:
    """The moments of ``asks``, stored; None if there are many, which the first rows mostly tell."""
    moments = asks.select(key, asked_at)
    if moments.limit(16 * FEW_MOMENTS).distinct().count() > FEW_MOMENTS:
        return None
    few = materialise(moments.distinct(), "moments")
    return few if few.count() <= FEW_MOMENTS else None


def _at_moments(asks: DataFrame, seen: DataFrame, key: str, asked_at: str, value: str, moments: DataFrame) -> DataFrame:
    """The same for asks at a few moments, whatever the size of a key.

    An observation belongs to the first moment of its key that is not before it;
    of each moment's observations the newest is kept before the shuffle.
    """
    times = moments.groupBy(key).agg(F.array_sort(F.collect_set(asked_at)).alias("_moments"))
    first = F.try_element_at(F.filter("_moments", lambda moment: moment >= F.col("_at")), F.lit(1))
    placed = seen.join(F.broadcast(times), key).select(key, "_at", "_held", first.alias("_moment"))
    placed = placed.where(F.col("_moment").isNotNull())
    newest = materialise(placed.groupBy(key, "_moment").agg(F.max("_at").alias("_at")), "newest")
    held = placed.join(F.broadcast(newest), [key, "_moment", "_at"]).groupBy(key, "_moment").agg(F.max("_held").alias("_held"))
    so_far = Window.partitionBy(key).orderBy("_moment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = moments.withColumnRenamed(asked_at, "_moment").join(held, [key, "_moment"], "left")
    latest = known.select(
        key, F.col("_moment").alias(asked_at), F.last("_held", ignorenulls=True).over(so_far)["value"].alias(value)
    )
    return asks.join(F.broadcast(latest), [key, asked_at], "left").select(*asks.columns, value)


def latest_before(
    asks: DataFrame,
    observations: DataFrame,
    key: str,
    asked_at: str,
    observed_at: str,
    value: str,
    fits: int = 1_000_000,
) -> DataFrame:
    """``asks`` with ``value`` of the latest observation of the same ``key``; NULL if none.

    Of observations at the same time the greatest value counts. If all asks are
    at a few moments, the observations are folded to these. Else rows per key
    are counted first: keys with more rows than one task should sort (``fits``)
    are worked on in ranges of time, all others as a whole.
    """
    held = F.struct(F.col(value).alias("value")).alias("_held")
    seen = observations.select(key, F.col(observed_at).alias("_at"), held).where(
        F.col(key).isNotNull() & F.col("_at").isNotNull()
    )
    placed = F.col(key).isNotNull() & F.col(asked_at).isNotNull()
    dated = asks.where(placed)
    missing = asks.where(~placed).withColumn(value, F.lit(None).cast(observations.schema[value].dataType))
    moments = _few_moments(dated, key, asked_at)
    if moments is not None:
        return _at_moments(dated, seen, key, asked_at, value, moments).unionByName(missing)
    hot = _hot_keys(dated.select(key).unionAll(seen.select(key)), key, fits)
    if hot.isEmpty():
        return _in_one_window(dated, seen, key, asked_at, value).unionByName(missing)
    hot = broadcast_if_small(hot, rows=HOT_KEYS)
    parts = {how: (dated.join(hot, key, how), seen.join(hot, key, how)) for how in ("left_anti", "left_semi")}
    whole = _in_one_window(*parts["left_anti"], key, asked_at, value)
    found = whole.unionByName(_in_ranges(*parts["left_semi"], key, asked_at, value)).unionByName(missing)
    return found.select(*asks.columns, value)
