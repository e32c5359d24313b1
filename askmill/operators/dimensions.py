"""Lookups in small tables: rubrics, ground truths, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when all of it is known to fit below this.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast after measuring it; leave the choice to the optimizer otherwise.

    The measurement is a plain count, so a table that turns out large costs one
    scan in which every task hands on a single row.
    """
    row_bytes = F.octet_length(F.to_json(F.struct(*df.columns)))
    seen = df.agg(F.count("*").alias("n"), F.sum(row_bytes).alias("size")).first()
    return F.broadcast(df) if seen["n"] <= rows and (seen["size"] or 0) <= size else df


def look_up(facts: DataFrame, dimension: DataFrame, keys: list[str], mode: str = "fail") -> tuple[DataFrame, DataFrame | None]:
    """Join each fact with its one dimension row; facts with none or with several are errors.

    ``mode='fail'`` raises while the job runs. ``mode='quarantine'`` returns the
    rejected facts as a second DataFrame.
    """
    others = [c for c in dimension.columns if c not in keys]
    single = dimension.groupBy(*keys).agg(
        F.count("*").alias("_entries"), *[F.first(F.col(f"`{c}`")).alias(c) for c in others]
    )
    side = broadcast_if_small(single)
    joined = facts.join(side, keys, "left").withColumn("_known", F.col("_entries") == 1)
    if mode == "quarantine":
        rejected = joined.where(~F.coalesce("_known", F.lit(False))).select(*facts.columns)
        return joined.where(F.col("_known")).drop("_known", "_entries"), rejected
    if mode != "fail":
        raise ValueError(f"mode is 'fail' or 'quarantine', not {mode!r}")
    shown = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    found = F.when(F.col("_entries") > 1, F.lit("several entries")).otherwise(F.lit("no entry"))
    message = F.concat(found, F.lit(f" for ({', '.join(keys)}) = "), shown)
    # The check is part of the filter, so it cannot be pruned away.
    checked = joined.where(F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    return checked.drop("_known", "_entries"), None
