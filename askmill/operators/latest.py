"""Picking rows out of append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(log: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """The newest row of each key.

    The filter sits directly on the rank, so each task passes on at most one
    row per key before the shuffle, however often a key was appended.
    """
    order = Window.partitionBy(*keys).orderBy(*newest_first)
    return log.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") == 1).drop("_nth")


def not_yet_judged(answers: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Answers without a verdict; only the key columns of the results are read. A NULL key equals a NULL key."""
    judged = results.select(*[F.col(k).alias(f"_judged_{k}") for k in keys])
    same = [answers[k].eqNullSafe(judged[f"_judged_{k}"]) for k in keys]
    return answers.join(judged, same, "left_anti")
