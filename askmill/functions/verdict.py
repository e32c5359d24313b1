"""Read score and explanation out of a judge's reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks a judge is told to write.
# ``(?U)``: blanks and digits of all scripts count; the four separator controls are
# blanks to a judge's tools but not to Java.
SCORE_PATTERN = r"(?U)\*\*Score:\*\*[\s\x1c-\x1f]*(\d+)"
# ``(?d)``: only a line feed ends a line, not a carriage return.
EXPLANATION_PATTERN = r"(?dU)\*\*Explanation:\*\*[\s\x1c-\x1f]*(.*)"


def _first_group(text: Column, pattern: str) -> Column:
    # A match may be empty, so "no match" is told apart by rlike.
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def verdict_score(text: Column) -> Column:
    """Digits after the score mark, first match; NULL when there is none."""
    return _first_group(text, SCORE_PATTERN)


def verdict_explanation(text: Column) -> Column:
    """Rest of the line after the explanation mark; NULL when there is none."""
    return _first_group(text, EXPLANATION_PATTERN)
