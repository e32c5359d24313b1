import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from askmill import schemas
from askmill.functions.vectors import HashingEmbedder
from askmill.operators.clients import ExtractiveStub, Reply
from askmill.operators.generate import generate
from askmill.operators.routes import plain_requests, route_questions
from askmill.operators.tools import resolve_tool_calls, tools_json, weather_tool
from askmill.operators.vectors import build_index
from askmill.plans.answers import LOG_COLUMNS, answer_questions

QUESTIONS = {
    "q0": "Who are you?",
    "q1": "Which song do you like?",
    "q6": "How much is two and two?",
    "q_rag": "What do herons eat in spring?",
    "q_function": "How is the weather in Oulu?",
}


def payload(text, degrees):
    return json.dumps({"current_condition": [{"temp_C": degrees, "weatherDesc": [{"value": text}]}]})


@pytest.fixture(scope="module")
def observations(spark):
    rows = [
        ("Oulu", dt.datetime(2024, 1, 1), payload("Snow", "-9")),
        ("Oulu", dt.datetime(2024, 6, 1), payload("Sun", "20")),
        ("Pori", dt.datetime(2099, 1, 1), payload("Fog", "1")),
    ]
    return spark.createDataFrame(rows, schemas.OBSERVATIONS)


def questions(spark, asked=QUESTIONS, models=("one", "two")):
    rows = [(m, "local", q, p, "Be kind.", "Context: {context} Question: {question}") for m in models for q, p in asked.items()]
    df = spark.createDataFrame(
        rows, "model string, endpoint string, question string, input_prompt string, system_prompt string, rag_prompt string"
    )
    return df.withColumn("extra_params", F.struct(F.lit(400).alias("max_tokens"), F.lit(0.7).alias("temperature")))


def index(spark):
    texts = [("doc_1", "Herons eat frogs in spring and fish"), ("doc_2", "Songs are sung loudly"), ("doc_3", "herons eat")]
    return build_index(spark.createDataFrame(texts, "id string, text string"))


def test_routes_and_params(spark):
    rows = route_questions(questions(spark, {**QUESTIONS, "other": "?"}, ("one",))).collect()
    got = {r.question: (r.answer_type, r.params.max_tokens, r.params.temperature) for r in rows}
    assert got == {
        "q0": ("normal", 400, 0.7),
        "q1": ("normal", 400, 0.7),
        "q6": ("normal", 2000, 0.01),
        "other": ("normal", 400, 0.7),
        "q_rag": ("rag", 400, 0.7),
        "q_function": ("function", 400, 0.7),
    }


def echo(request):
    told = {
        "tokens": request.max_tokens,
        "temperature": request.temperature,
        "endpoint": request.endpoint,
        "roles": [m["role"] for m in request.messages],
    }
    return Reply(text=json.dumps(told))


def test_requests_reach_the_client(spark):
    replies = generate(plain_requests(route_questions(questions(spark, models=("one",)))), lambda: echo).collect()
    got = {r.question: json.loads(r.ai_output) for r in replies}
    assert set(got) == {"q0", "q1", "q6"}
    assert got["q6"] == {"tokens": 2000, "temperature": 0.01, "endpoint": "local", "roles": ["system", "user"]}


def test_generate_passes_columns_through(spark):
    moment = dt.datetime(2024, 5, 1, 12, 30)
    request = json.dumps({"messages": [{"role": "user", "content": "one two three"}]})
    df = spark.createDataFrame([(request, moment, [1, None])], "request string, ts timestamp, xs array<int>")
    row = generate(df, lambda: ExtractiveStub(2)).first()
    assert (row.ai_output, row.ts, row.xs, row.error, row.tool_calls) == ("one two", moment, [1, None], None, None)
    assert row.time_s >= 0


def test_failed_calls_keep_their_row(spark):
    request = json.dumps({"messages": [{"role": "user", "content": "boom"}]})
    row = generate(spark.createDataFrame([(request,)], "request string"), lambda: ExtractiveStub(fail_on="boom")).first()
    assert (row.ai_output, row.error) == (None, "RuntimeError")


def test_pacing_is_a_ceiling(spark):
    request = json.dumps({"messages": [{"role": "user", "content": "x"}]})
    df = spark.createDataFrame([(request,)] * 8, "request string")
    begun = time.time()
    assert generate(df, ExtractiveStub, parallelism=2, requests_per_second=4).count() == 8
    # Four calls per task, half a second apart.
    assert time.time() - begun >= 1.5


def test_calls_of_one_partition_run_in_many_tasks(spark):
    request = json.dumps({"messages": [{"role": "user", "content": "hi"}]})
    df = spark.createDataFrame([(request,)] * 64, "request string").coalesce(1)
    tasks = generate(df, ExtractiveStub).select(F.spark_partition_id()).distinct().count()
    assert tasks == spark.sparkContext.defaultParallelism


def test_all_routes(spark, observations):
    answers = answer_questions(
        questions(spark), index(spark), lambda: ExtractiveStub(5), [weather_tool(observations)], HashingEmbedder(), k=2
    )
    assert tuple(answers.columns) == LOG_COLUMNS
    rows = answers.collect()
    assert len(rows) == 10 and {r.model for r in rows} == {"one", "two"}
    got = {r.question: (r.answer_type, r.ai_output) for r in rows}
    assert got == {
        "q0": ("normal", "Who are you?"),
        "q1": ("normal", "Which song do you like?"),
        "q6": ("normal", "How much is two and"),
        "q_rag": ("rag", "Context: herons eat Herons eat"),
        "q_function": ("function", "Weather in Oulu is Sun, 20°C"),
    }
    assert all(r.failed is False and r.error is None and r.time_s is not None for r in rows)


def test_each_question_is_asked_once(spark, observations, tmp_path):
    log = str(tmp_path)

    class Counting:
        def __call__(self, request):
            with open(f"{log}/{time.time_ns()}-{id(request)}-{hash(request.user_text)}", "w"):
                return ExtractiveStub()(request)

    answers = answer_questions(questions(spark), index(spark), Counting, [weather_tool(observations)], HashingEmbedder())
    answers.collect()
    answers.count()
    assert len(list(tmp_path.iterdir())) == 10


def call(arguments, name="get_weather"):
    return {"function": {"name": name, "arguments": arguments}}


@pytest.mark.parametrize(
    "calls,error,output,problem",
    [
        (None, None, None, None),
        ("[]", None, None, None),
        (json.dumps([call('{"city": "Oulu"}')]), None, "Weather in Oulu is Sun, 20°C", None),
        (json.dumps([call('{"city": "Pori"}')]), None, None, None),
        (json.dumps([call('{"city": "Nowhere"}')]), None, None, None),
        (json.dumps([call('{"city": "Oulu"}')] * 2), None, "❌", "multiple_tool_calls"),
        (json.dumps([call("{city")]), None, "❌", "unreadable_arguments"),
        (json.dumps([call('{"town": "Oulu"}')]), None, "❌", "unreadable_arguments"),
        (json.dumps([call('{"city": "Oulu"}', "other")]), None, "❌", "unknown_tool"),
        ("not json", None, "❌", "unreadable_tool_calls"),
        (None, "TimeoutError", "❌", "TimeoutError"),
    ],
)
def test_tool_calls(spark, observations, calls, error, output, problem):
    row = (calls, error, dt.datetime(2025, 1, 1), None, 0.5)
    df = spark.createDataFrame([row], "tool_calls string, error string, asked_at timestamp, ai_output string, time_s double")
    got = resolve_tool_calls(df, [weather_tool(observations)]).collect()
    assert [(r.ai_output, r.error, r.time_s) for r in got] == [(output, problem, 0.5)]


def test_tool_declaration(spark, observations):
    (tool,) = json.loads(tools_json([weather_tool(observations)]))
    assert tool["function"]["parameters"]["required"] == ["city"]


def test_no_tool_call_gives_null(spark, observations):
    asked = {"q_function": "Say hello"}
    rows = answer_questions(
        questions(spark, asked, ("one",)), index(spark), ExtractiveStub, [weather_tool(observations)], HashingEmbedder()
    ).collect()
    assert [(r.ai_output, r.failed) for r in rows] == [(None, False)]
