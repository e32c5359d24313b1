"""Answer phase: questions along their routes into the answer log."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.operators.clients import Client
from askmill.operators.generate import generate
from askmill.operators.routes import OVERRIDES, plain_requests, rag_requests, route_questions, tool_requests
from askmill.operators.tools import FAILED, ToolSpec, resolve_tool_calls, tools_json
from askmill.session import materialise
from askmill.sources.tables import append_table

LOG_COLUMNS = (
    "ai_output",
    "question",
    "input_prompt",
    "time_s",
    "model",
    "answer_type",
    "inserted",
    "failed",
    "error",
)


def answer_questions(
    questions: DataFrame,
    index: DataFrame,
    client_factory: Callable[[], Client],
    tools: list[ToolSpec],
    embedder=None,
    k: int = 4,
    overrides: Mapping[str, Mapping] = OVERRIDES,
    parallelism: int | None = None,
    requests_per_second: float | None = None,
) -> DataFrame:
    """Answers to all questions, in the shape of the answer log.

    The three routes differ in how a request is built; the requests are then
    one DataFrame, so one pass of model calls shares tasks and pacing. The raw
    replies are written once: tool calls are resolved from the stored rows, and
    no model is called twice.
    """
    routed = route_questions(questions, overrides)
    requests = (
        plain_requests(routed)
        .unionByName(rag_requests(routed, index, embedder, k))
        .unionByName(tool_requests(routed, tools_json(tools)))
    )
    called = generate(requests, client_factory, parallelism, requests_per_second)
    stored = materialise(called.withColumn("asked_at", F.current_timestamp()), "replies")
    plain = stored.where(F.col("answer_type") != "function").withColumn(
        "ai_output", F.when(F.col("error").isNotNull(), F.lit(FAILED)).otherwise(F.col("ai_output"))
    )
    with_tools = resolve_tool_calls(stored.where(F.col("answer_type") == "function"), tools)
    both = plain.unionByName(with_tools)
    return both.withColumns({"failed": F.col("error").isNotNull(), "inserted": F.col("asked_at")}).select(*LOG_COLUMNS)


def log_answers(answers: DataFrame, table: str) -> None:
    """Append one batch of answers, partitioned by model so that readers can prune."""
    append_table(answers, table, partition_by=("model",))
