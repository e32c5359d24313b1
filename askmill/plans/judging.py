"""Judge phase: logged answers to verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.operators.clients import Client
from askmill.operators.dimensions import look_up
from askmill.operators.judge import (
    EXCLUDED,
    judge_by_graded_similarity,
    judge_by_rubric,
    judge_by_similarity,
    to_judge,
    token_similarity,
    tool_truths,
)
from askmill.operators.latest import not_yet_judged

ANSWER_KEYS = ["model", "question", "input_prompt", "inserted"]
SETTINGS = ("judge_endpoint", "judge_params", "judge_system_prompt", "rag_ground_truth")
# Asked for graded similarity, where the settings name it.
OPTIONAL_SETTINGS = ("similarity_endpoint",)
VERDICT_COLUMNS = ("score", "explanation", "score_num")


def judge_answers(
    answers: DataFrame,
    settings: DataFrame,
    rubrics: DataFrame,
    observations: DataFrame,
    client_factory: Callable[[], Client],
    city: str,
    results: DataFrame | None = None,
    excluded: Sequence[str] = EXCLUDED,
    scorer: Callable[[Column, Column], tuple[Column, Column]] = token_similarity,
    similarity_factory: Callable[[], Client] | None = None,
    mode: str = "fail",
    parallelism: int | None = None,
    requests_per_second: float | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Verdicts, and in quarantine mode the answers that could not be judged.

    ``answers`` is the stored log and ``settings`` the judge settings per model.
    With ``results`` only answers without a verdict are judged. Plain answers go
    to the judge model, all others to the similarity scorer or, when given, to
    the model of ``similarity_factory``. Write the verdicts before reading them:
    they hold model calls.
    """
    columns = answers.columns
    pending = to_judge(answers, excluded)
    if results is not None:
        pending = not_yet_judged(pending, results, ANSWER_KEYS)
    optional = [c for c in OPTIONAL_SETTINGS if c in settings.columns]
    routed, no_settings = look_up(pending, settings.select("model", *SETTINGS, *optional), ["model"], mode)
    kind = F.col("answer_type")
    known = F.coalesce(kind.isin("normal", "rag", "function"), F.lit(False))
    if mode == "fail":
        complaint = F.raise_error(F.concat(F.lit("answer type is neither rag nor function: "), kind))
        routed = routed.where(F.when(known, F.lit(True)).otherwise(complaint.cast("boolean")))

    by_rubric, no_rubric = judge_by_rubric(
        routed.where(kind == "normal"), rubrics, client_factory, mode, parallelism, requests_per_second
    )
    rag = routed.where(kind == "rag").withColumn("truth", F.col("rag_ground_truth"))
    function = tool_truths(routed.where(kind == "function"), observations, city)
    with_truth = rag.unionByName(function)
    if similarity_factory is None:
        by_similarity, _ = judge_by_similarity(with_truth, scorer=scorer)
    else:
        by_similarity = judge_by_graded_similarity(
            with_truth, similarity_factory, parallelism=parallelism, requests_per_second=requests_per_second
        )
    verdicts = by_rubric.select(*columns, *VERDICT_COLUMNS).unionByName(
        by_similarity.select(*columns, *VERDICT_COLUMNS)
    )
    if mode == "fail":
        return verdicts, None
    rejected = no_settings.unionByName(no_rubric.select(*columns)).unionByName(routed.where(~known).select(*columns))
    return verdicts, rejected
