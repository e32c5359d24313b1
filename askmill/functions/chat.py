"""Chat requests, tool calls and tool results as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askmill import schemas


def messages(system: Column, user: Column) -> Column:
    """A system message and a user message as ``array<struct<role, content>>``."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", system), message("user", user))


def messages_json(chat: Column) -> Column:
    return F.to_json(F.struct(chat.alias("messages")))


def user_content(request: Column) -> Column:
    """The user's text out of a request built by :func:`messages_json`."""
    return F.get_json_object(request, "$.messages[1].content")


def parse_tool_calls(text: Column) -> Column:
    return F.from_json(text, schemas.TOOL_CALLS)


def tool_argument(calls: Column, name: str) -> Column:
    """One argument of the first call; NULL without calls or for bad JSON."""
    arguments = F.try_element_at(calls, F.lit(1))["function"]["arguments"]
    return F.get_json_object(arguments, f"$.{name}")


def weather_sentence(city: Column, payload_json: Column) -> Column:
    """``Weather in <city> is <description>, <degrees>°C``; NULL without a payload."""
    now = F.try_element_at(F.from_json(payload_json, schemas.WEATHER)["current_condition"], F.lit(1))
    described = F.try_element_at(now["weatherDesc"], F.lit(1))["value"]
    # concat gives NULL when any part is missing.
    return F.concat(
        F.lit("Weather in "), city, F.lit(" is "), described, F.lit(", "), now["temp_C"], F.lit("°C")
    )
