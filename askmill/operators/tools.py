"""Tools a model may call. A tool is a join with a table, not a row callback."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.functions.chat import parse_tool_calls, tool_argument, weather_sentence
from askmill.operators.asof import latest_before

# Fixed value: what stands for a failed tool call in the answer log.
FAILED = "❌"


@dataclass(frozen=True)
class ToolSpec:
    """``enrich`` turns ``(<argument>, asked_at)`` rows into the same plus ``tool_output``."""

    name: str
    description: str
    argument: str
    argument_description: str
    enrich: Callable[[DataFrame], DataFrame]

    def declaration(self) -> dict:
        described = {"type": "string", "description": self.argument_description}
        return {
            "type": "function",
            "function": {
                "name": self.name,
                "description": self.description,
                "parameters": {
                    "type": "object",
                    "properties": {self.argument: described},
                    "required": [self.argument],
                },
            },
        }


def tools_json(tools: list[ToolSpec]) -> str:
    return json.dumps([tool.declaration() for tool in tools], ensure_ascii=False)


def weather_tool(observations: DataFrame) -> ToolSpec:
    """Weather of a city out of ``observations(city, observed_at, payload_json)``."""

    def enrich(calls: DataFrame) -> DataFrame:
        found = latest_before(calls, observations, "city", "asked_at", "observed_at", "payload_json")
        return found.withColumn("tool_output", weather_sentence(F.col("city"), F.col("payload_json"))).drop(
            "payload_json"
        )

    return ToolSpec("get_weather", "Latest observed weather of one place", "city", "Name of the place", enrich)


def resolve_tool_calls(replies: DataFrame, tools: list[ToolSpec]) -> DataFrame:
    """Turn the tool calls of ``replies`` into answers.

    ``replies`` must be stored (they are read more than once) and carry
    ``tool_calls``, ``error`` and ``asked_at``. No call gives NULL; one call
    gives the tool's output; several calls, arguments that cannot be read, an
    unknown tool or a failed model call give the failure mark.
    """
    calls = parse_tool_calls(F.col("tool_calls"))
    n_calls = F.coalesce(F.size(calls), F.lit(0))
    name = F.try_element_at(calls, F.lit(1))["function"]["name"]
    argument = F.lit(None).cast("string")
    for tool in tools:
        argument = F.when(name == tool.name, tool_argument(calls, tool.argument)).otherwise(argument)
    known = name.isin([tool.name for tool in tools])
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("tool_calls").isNull(), F.lit(None))
        .when(calls.isNull(), F.lit("unreadable_tool_calls"))
        .when(n_calls > 1, F.lit("multiple_tool_calls"))
        .when(n_calls == 0, F.lit(None))
        .when(~F.coalesce(known, F.lit(False)), F.lit("unknown_tool"))
        .when(argument.isNull(), F.lit("unreadable_arguments"))
    )
    read = replies.withColumns({"_problem": problem, "_tool": F.when(n_calls == 1, name), "_argument": argument})
    runnable = F.col("_problem").isNull() & F.col("_argument").isNotNull()
    outputs = read.where(~runnable).withColumn("tool_output", F.lit(None).cast("string"))
    for tool in tools:
        own = read.where(runnable & (F.col("_tool") == tool.name)).withColumnRenamed("_argument", tool.argument)
        outputs = outputs.unionByName(tool.enrich(own).withColumnRenamed(tool.argument, "_argument"))
    return (
        outputs.withColumn(
            "ai_output", F.when(F.col("_problem").isNotNull(), F.lit(FAILED)).otherwise(F.col("tool_output"))
        )
        .withColumn("error", F.col("_problem"))
        .drop("_problem", "_tool", "_argument", "tool_output")
    )
