"""Scores and seconds, as numbers and as report text."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _digits() -> tuple[str, str]:
    """The decimal digits of all scripts but ASCII, and the ASCII digit of each."""
    found = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.decimal(c, None) is not None]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def score_number(score: Column) -> Column:
    """Numeric score in the digits of any script, or NULL for text such as 'None', for NaN and for infinities."""
    value = F.translate(score.cast("string"), *_digits()).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def mean_text(value: Column, suffix: str = "") -> Column:
    """Mean to two decimals, half up, as text.

    Summed as decimals, so the result does not depend on the order in which
    tasks add up.
    """
    mean = F.round(F.avg(value.cast("decimal(20,6)")), 2)
    return F.concat(mean.cast("double").cast("string"), F.lit(suffix))


def seconds_text(seconds: Column) -> Column:
    return F.concat(seconds.cast("string"), F.lit("s"))
