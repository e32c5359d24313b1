"""Score and speed per question, with totals, for one model or side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.functions.numbers import mean_text, score_number, seconds_text
from askmill.functions.text import question_label, relabel
from askmill.operators.latest import latest_per_key
from askmill.operators.tools import FAILED
from askmill.session import materialise

# Labels of the total rows, display names and what averages leave out.
SCORE_ROW = "Overall situation:"
SPEED_ROW = " Avg Speed:"
DISPLAY_NAMES = {"qr": "RAG", "qf": "FUNCTION"}
FUNCTION_QUESTION = "q_function"


def relabelled(results: DataFrame, names: Mapping[str, str] = DISPLAY_NAMES) -> DataFrame:
    """Results under display names, ordered by question.

    There are few questions, so within one the order goes on by a hash: a sort
    can then split the rows of a question over many tasks.
    """
    renamed = results.withColumn("question", relabel(F.col("question"), names))
    return renamed.orderBy("question", F.xxhash64(*renamed.columns))


def averages(
    results: DataFrame, by: Sequence[str] = ("model",), exclude: Sequence[str] = (FUNCTION_QUESTION,), truncate: bool = False
) -> DataFrame:
    """Mean score and mean seconds per model, as report text, and how many rows had no score.

    ``truncate`` cuts scores and seconds to whole numbers first.
    """
    score, seconds = score_number(F.col("score")), F.col("time_s").cast("double")
    if truncate:
        score, seconds = score.cast("int"), seconds.cast("int")
    left_out = F.coalesce(F.col("question").isin(list(exclude)), F.lit(False))
    kept = results.where(~left_out) if exclude else results
    return kept.groupBy(*by).agg(
        mean_text(score).alias("avg_score"),
        mean_text(seconds, "s").alias("avg_speed"),
        F.count_if(score.isNull()).alias("n_unscored"),
    )


def _details(results: DataFrame, names: Mapping[str, str], mask: Sequence[str]) -> list[Column]:
    """Label, score and speed of a result row; the score of masked questions is crossed out."""
    score = F.col("score")
    if mask:
        score = F.when(F.col("question").isin(list(mask)), F.lit(FAILED)).otherwise(score)
    return [
        question_label(relabel(F.col("question"), names), F.col("input_prompt")).alias("Questions"),
        score.alias("score_text"),
        seconds_text(F.col("time_s")).alias("speed_text"),
    ]


def _totals(results: DataFrame, exclude: Sequence[str], truncate: bool) -> DataFrame:
    """Two rows per model below the details: mean score, then mean speed."""
    rows = F.array(
        F.struct(F.lit(1).alias("section"), F.lit(SCORE_ROW).alias("Questions"), F.col("avg_score").alias("score_text")),
        F.struct(F.lit(2).alias("section"), F.lit(SPEED_ROW).alias("Questions"), F.col("avg_speed").alias("score_text")),
    )
    return averages(results, ("model",), exclude, truncate).select("model", F.inline(rows))


def report_rows(
    results: DataFrame,
    exclude: Sequence[str] = (FUNCTION_QUESTION,),
    truncate: bool = False,
    names: Mapping[str, str] = DISPLAY_NAMES,
    mask: Sequence[str] = (FUNCTION_QUESTION,),
) -> DataFrame:
    """``(section, model, Questions, score_text, speed_text)`` for all models.

    Section 0 holds one row per result, 1 the mean score, 2 the mean speed.
    """
    details = results.select("model", F.lit(0).alias("section"), *_details(results, names, mask))
    both = details.unionByName(_totals(results, exclude, truncate), allowMissingColumns=True)
    return both.fillna("").select("section", "model", "Questions", "score_text", "speed_text")


def model_report(
    results: DataFrame,
    model: str,
    exclude: Sequence[str] = (FUNCTION_QUESTION,),
    truncate: bool = False,
    names: Mapping[str, str] = DISPLAY_NAMES,
    mask: Sequence[str] = (FUNCTION_QUESTION,),
    placeholders: Sequence[str] = (),
) -> DataFrame:
    """One model's report: ``Questions, <model>, <model> speed`` and empty placeholder columns."""
    own = report_rows(results.where(F.col("model") == model), exclude, truncate, names, mask)
    # Score and speed only serve to split the rows of one question over tasks.
    return own.orderBy("section", "Questions", "score_text", "speed_text").select(
        "Questions",
        F.col("score_text").alias(model),
        F.col("speed_text").alias(f"{model} speed"),
        *[F.lit("").alias(other) for other in placeholders],
    )


def comparison(
    results: DataFrame,
    models: Sequence[str],
    exclude: Sequence[str] = (FUNCTION_QUESTION,),
    truncate: bool = False,
    names: Mapping[str, str] = DISPLAY_NAMES,
    mask: Sequence[str] = (FUNCTION_QUESTION,),
    newest_first: Sequence[Column] | None = None,
) -> DataFrame:
    """All models side by side, two columns per model; models without results stay ''.

    Of reruns the newest answer per model and question counts; of several at the
    same time always the same one.
    """
    newest = list(newest_first) if newest_first else [F.col("inserted").desc()]
    newest.append(F.xxhash64(*results.columns))
    current = latest_per_key(
        results.where(F.col("model").isin(list(models))), ["model", "question", "input_prompt"], newest
    )
    # Details and totals read it: stored, so that the log is read and ranked once.
    current = materialise(current.select("model", "question", "input_prompt", "score", "time_s"), "current")
    rows = report_rows(current, exclude, truncate, names, mask)
    # One conditional aggregate per model: a single shuffle, where pivot() takes two.
    columns = []
    for model in models:
        own = F.col("model") == model
        columns.append(F.coalesce(F.max(F.when(own, F.col("score_text"))), F.lit("")).alias(model))
        columns.append(F.coalesce(F.max(F.when(own, F.col("speed_text"))), F.lit("")).alias(f"{model} speed"))
    wide = rows.groupBy("section", "Questions").agg(*columns)
    return wide.orderBy("section", "Questions").drop("section")
