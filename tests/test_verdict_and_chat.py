import json

import pytest
from pyspark.sql import functions as F

from askmill.functions import chat
from askmill.functions.numbers import mean_text, score_number
from askmill.functions.verdict import verdict_explanation, verdict_score

CASES = [
    ("**Score:** 4\n**Explanation:** ok", "4", "ok"),
    ("no marks at all", None, None),
    ("**Score:** 3\n**Explanation:**", "3", ""),
    ("**Score:** 4/5", "4", None),
    ("**Score:** 4.5", "4", None),
    ("**Score:**12 **Explanation:** a\rb c\nd", "12", "a\rb c"),
    ("**Score:** _\n**Score:** 2\n**Score:** 5\n**Explanation:** x\n**Explanation:** y", "2", "x"),
    ("Score: 4", None, None),
    ("**Explanation:**\n\n  next line", None, "next line"),
    ("**Score:**\u00a04\n**Explanation:**\u202f\x1c fine", "4", "fine"),
    ("**Score:** ٤\n**Explanation:** عربي", "٤", "عربي"),
    (None, None, None),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string").orderBy("i")
    got = df.select(verdict_score(F.col("t")), verdict_explanation(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(s, e) for _, s, e in CASES]


def test_score_numbers(spark):
    df = spark.createDataFrame([(t,) for t in ["4", "4.0", "None", "nan", "NaN", None, "", "inf", "-Infinity", "٣", "४.५"]], "s string")
    assert [r[0] for r in df.select(score_number(F.col("s"))).collect()] == [4.0, 4.0, *[None] * 7, 3.0, 4.5]


@pytest.mark.parametrize("values,shown", [([3.0, 3.25], "3.13"), ([4.0], "4.0"), ([1.0, 2.0, 2.0], "1.67")])
def test_means_round_half_up(spark, values, shown):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.agg(mean_text(F.col("v"), "s")).first()[0] == shown + "s"


def test_messages_json_keeps_text(spark):
    text = 'quote " back\\slash\nline’s ❌ {question}'
    df = spark.createDataFrame([(text,)], "t string")
    request = chat.messages_json(chat.messages(F.lit("sys"), F.col("t")))
    row = df.select(request.alias("r"), chat.user_content(request).alias("u")).first()
    expected = [{"role": "system", "content": "sys"}, {"role": "user", "content": text}]
    assert json.loads(row.r)["messages"] == expected
    assert "’" in row.r and row.u == text


def test_tool_arguments(spark):
    def call(arguments):
        return {"function": {"name": "get_weather", "arguments": arguments}}

    texts = [json.dumps([call('{"city": "Oulu"}')]), "[]", json.dumps([call("not json")]), "junk", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = df.select(chat.tool_argument(chat.parse_tool_calls(F.col("t")), "city")).collect()
    assert [r[0] for r in got] == ["Oulu", None, None, None, None]


def test_weather_sentence(spark):
    good = json.dumps({"current_condition": [{"temp_C": "-3", "weatherDesc": [{"value": "Snow"}]}]})
    rows = [(0, "Oulu", good), (1, "Oulu", '{"current_condition": []}'), (2, "Oulu", None)]
    df = spark.createDataFrame(rows, "i int, c string, p string").orderBy("i")
    got = [r[0] for r in df.select(chat.weather_sentence(F.col("c"), F.col("p"))).collect()]
    assert got == ["Weather in Oulu is Snow, -3°C", None, None]
