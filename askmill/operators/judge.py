"""Scoring answers: by rubric with a judge model, or by similarity to a truth."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill import schemas
from askmill.functions.chat import messages, messages_json, weather_sentence
from askmill.functions.numbers import score_number
from askmill.functions.text import fill_pieces, render, template_pieces
from askmill.functions.vectors import text_cosine
from askmill.functions.verdict import verdict_explanation, verdict_score
from askmill.operators.asof import latest_before
from askmill.operators.clients import Client
from askmill.operators.dimensions import broadcast_if_small, look_up
from askmill.operators.generate import generate

# The introduction is never judged; what a judge may write.
EXCLUDED = ("q0",)
JUDGE_PARAMS = {"max_tokens": 250, "temperature": 0.1}
SCORES = (1, 2, 3, 4, 5)
# The two marks that a verdict is read by.
REPLY_FORM = "Write two lines and nothing else:\n**Score:** <mark>\n**Explanation:** <why>\n"


def rubric_template(persona: str, levels: Sequence[str], subject: str = "accuracy") -> str:
    """A rubric with slots ``{question}`` and ``{answer}``: who judges, what each score means."""
    if len(levels) != len(SCORES):
        raise ValueError(f"a rubric describes {len(SCORES)} scores, got {len(levels)}")
    scale = "\n".join(f"{score} means: {level}" for score, level in zip(SCORES, levels))
    return (
        f"Read as {persona} and give the answer below a mark for its {subject}.\n\n{scale}\n\n"
        "Asked: {question}\nReplied: {answer}\n\n" + REPLY_FORM
    )


def rubrics_table(spark: SparkSession, templates: Mapping[str, str]) -> DataFrame:
    """``(question, rubric_template)`` from templates keyed by question."""
    return spark.createDataFrame(list(templates.items()), schemas.RUBRICS)


def to_judge(answers: DataFrame, excluded: Sequence[str] = EXCLUDED) -> DataFrame:
    """Answers of all questions but the excluded ones; an answer without a question stays."""
    return answers.where(F.coalesce(~F.col("question").isin(list(excluded)), F.lit(True))) if excluded else answers


def rubric_prompts(answers: DataFrame, rubrics: DataFrame, mode: str = "fail") -> tuple[DataFrame, DataFrame | None]:
    """Add ``judge_prompt``; answers whose question has no rubric are errors."""
    slots = {"question": F.col("input_prompt"), "answer": F.col("ai_output")}
    # Templates are cut once per rubric, before the join repeats them per answer.
    cut = rubrics.select("question", template_pieces(F.col("rubric_template"), slots).alias("_pieces"))
    known, rejected = look_up(answers, cut, ["question"], mode)
    return known.withColumn("judge_prompt", fill_pieces(F.col("_pieces"), slots)).drop("_pieces"), rejected


def with_verdict(replies: DataFrame, text: str) -> DataFrame:
    """Add ``score``, ``explanation`` and ``score_num`` read out of a judge's reply."""
    read = replies.withColumns(
        {"score": verdict_score(F.col(text)), "explanation": verdict_explanation(F.col(text))}
    )
    return read.withColumn("score_num", score_number(F.col("score")))


def _ask_judge(
    prompts: DataFrame,
    columns: Sequence[str],
    client_factory: Callable[[], Client],
    parallelism: int | None,
    requests_per_second: float | None,
    endpoint: str = "judge_endpoint",
) -> DataFrame:
    """Send ``judge_prompt`` to the model at ``endpoint`` and read its verdict; keeps ``columns``."""
    requests = prompts.select(
        F.struct(*[F.col(c) for c in columns]).alias("answer"),
        messages_json(messages(F.col("judge_system_prompt"), F.col("judge_prompt"))).alias("request"),
        F.col("judge_params").alias("params"),
        F.col(endpoint).alias("endpoint"),
    )
    replies = generate(requests, client_factory, parallelism, requests_per_second)
    verdicts = with_verdict(replies.select("answer", F.col("ai_output").alias("reply")), "reply")
    return verdicts.select("answer.*", "score", "explanation", "score_num")


def judge_by_rubric(
    answers: DataFrame,
    rubrics: DataFrame,
    client_factory: Callable[[], Client],
    mode: str = "fail",
    parallelism: int | None = None,
    requests_per_second: float | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Verdicts of a judge model. ``answers`` carries the judge's settings as columns."""
    prompts, rejected = rubric_prompts(answers, rubrics, mode)
    return _ask_judge(prompts, answers.columns, client_factory, parallelism, requests_per_second), rejected


SIMILARITY_TEMPLATE = (
    "Mark from 1 to 5 how far the reply says the same as the reference.\n\n"
    "Asked: {question}\nReplied: {answer}\nReference: {truth}\n\n" + REPLY_FORM
)


def judge_by_graded_similarity(
    answers: DataFrame,
    client_factory: Callable[[], Client],
    template: str = SIMILARITY_TEMPLATE,
    parallelism: int | None = None,
    requests_per_second: float | None = None,
) -> DataFrame:
    """Similarity to the column ``truth`` as graded by the model at ``similarity_endpoint``, if answers carry one."""
    slots = {"question": F.col("input_prompt"), "answer": F.col("ai_output"), "truth": F.col("truth")}
    prompts = answers.withColumn("judge_prompt", render(template, slots))
    columns = [c for c in answers.columns if c != "truth"]
    endpoint = "similarity_endpoint" if "similarity_endpoint" in answers.columns else "judge_endpoint"
    return _ask_judge(prompts, columns, client_factory, parallelism, requests_per_second, endpoint)


def cosine_score(cosine: Column) -> Column:
    """1 to 5 in even steps of the cosine; NULL stays NULL."""
    return F.when(cosine.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), F.ceil(cosine * 5))).cast("int"))


def token_similarity(output: Column, truth: Column) -> tuple[Column, Column]:
    """Default scorer: ``(score, justification)`` from the words two texts share.

    A stand-in that needs no model; its values do not compare with those of a
    model-graded metric.
    """
    cosine = F.round(text_cosine(output, truth), 6)
    shown = F.when(cosine.isNotNull(), F.format_string("token cosine %.6f", cosine))
    return cosine_score(cosine).cast("string"), shown


def tool_truths(answers: DataFrame, observations: DataFrame, city: str) -> DataFrame:
    """Truth of tool answers: the weather in ``city`` when the answer was logged."""
    times = answers.select(F.col("inserted").alias("_asked")).distinct().withColumn("_city", F.lit(city))
    seen = observations.where(F.col("city") == city).withColumnRenamed("city", "_city")
    found = latest_before(times, seen, "_city", "_asked", "observed_at", "payload_json")
    truths = found.select("_asked", weather_sentence(F.col("_city"), F.col("payload_json")).alias("truth"))
    # One row a batch of answers, as all rows of a batch carry its time.
    return answers.join(broadcast_if_small(truths), F.col("inserted").eqNullSafe(F.col("_asked")), "left").drop("_asked")


def judge_by_similarity(
    answers: DataFrame,
    truths: DataFrame | None = None,
    keys: Sequence[str] = ("model", "answer_type"),
    scorer: Callable[[Column, Column], tuple[Column, Column]] = token_similarity,
    mode: str = "fail",
) -> tuple[DataFrame, DataFrame | None]:
    """Verdicts by similarity to a truth, looked up in ``truths`` or already a column."""
    columns = [c for c in answers.columns if c != "truth"]
    known, rejected = (answers, None) if truths is None else look_up(answers, truths, list(keys), mode)
    score, justification = scorer(F.col("ai_output"), F.col("truth"))
    scored = known.select(*columns, score.alias("score"), justification.alias("explanation"))
    return scored.withColumn("score_num", score_number(F.col("score"))), rejected
