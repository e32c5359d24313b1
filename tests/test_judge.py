import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from askmill import schemas
from askmill.operators.clients import Reply
from askmill.operators.dimensions import broadcast_if_small, look_up
from askmill.operators.judge import judge_by_similarity, rubric_template, rubrics_table, to_judge, tool_truths
from askmill.operators.latest import latest_per_key, not_yet_judged
from askmill.plans.judging import judge_answers

LEVELS = ["wrong", "weak", "fair", "good", "great"]
NOW = dt.datetime(2024, 7, 1)
WEATHER = "Weather in Oulu is Sun, 20°C"


def answer(question, text, kind="normal", model="one", inserted=NOW):
    return (text, question, f"ask {question}", 1.5, model, kind, inserted, False, None)


def answers(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.ANSWERS)


@pytest.fixture(scope="module")
def rubrics(spark):
    return rubrics_table(spark, {q: rubric_template("a critic", LEVELS) for q in ("q1", "q2")})


@pytest.fixture(scope="module")
def settings(spark):
    rows = [("one", "judge", (250, 0.1), "Judge well.", "the true words"), ("two", "judge", (250, 0.1), "J", "else")]
    return spark.createDataFrame(
        rows, f"model string, judge_endpoint string, judge_params {schemas.PARAMS}, judge_system_prompt string, rag_ground_truth string"
    )


@pytest.fixture(scope="module")
def observations(spark):
    condition = {"current_condition": [{"temp_C": "20", "weatherDesc": [{"value": "Sun"}]}]}
    rows = [("Oulu", dt.datetime(2024, 6, 1), json.dumps(condition)), ("Oulu", dt.datetime(2024, 8, 1), "{}")]
    return spark.createDataFrame(rows, schemas.OBSERVATIONS)


def judge(request):
    assert request.messages[0] == {"role": "system", "content": "Judge well."}
    assert (request.max_tokens, request.temperature) == (250, 0.1)
    if "great" in request.user_text and "splendid" in request.user_text:
        return Reply(text="**Score:** 5\n**Explanation:** fine\nmore")
    return Reply(text="I will not score this")


def test_all_answer_types(spark, rubrics, settings, observations):
    log = answers(
        spark,
        answer("q0", "hello"),
        answer("q1", "splendid"),
        answer("q2", "dull"),
        answer("q_rag", "the true words", "rag"),
        answer("q_function", WEATHER, "function"),
    )
    verdicts, rejected = judge_answers(log, settings, rubrics, observations, lambda: judge, "Oulu")
    assert rejected is None
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in verdicts.schema) == schemas.VERDICTS
    got = {r.question: (r.score, r.explanation, r.score_num) for r in verdicts.collect()}
    assert got == {
        "q1": ("5", "fine", 5.0),
        "q2": (None, None, None),
        "q_rag": ("5", "token cosine 1.000000", 5.0),
        "q_function": ("5", "token cosine 1.000000", 5.0),
    }


def test_unknown_question_fails_the_job(spark, rubrics, settings, observations):
    verdicts, _ = judge_answers(answers(spark, answer("q9", "x")), settings, rubrics, observations, lambda: judge, "Oulu")
    with pytest.raises(Exception, match="no entry for .question. = q9"):
        verdicts.collect()


def test_unknown_answer_type_fails_the_job(spark, rubrics, settings, observations):
    log = answers(spark, answer("q1", "x", "poem"))
    with pytest.raises(Exception, match="neither rag nor function: poem"):
        judge_answers(log, settings, rubrics, observations, lambda: judge, "Oulu")[0].collect()


def test_quarantine_keeps_what_cannot_be_judged(spark, rubrics, settings, observations):
    log = answers(spark, answer("q1", "splendid"), answer("q9", "x"), answer("q1", "x", "poem"))
    verdicts, rejected = judge_answers(log, settings, rubrics, observations, lambda: judge, "Oulu", mode="quarantine")
    assert [r.question for r in verdicts.collect()] == ["q1"]
    assert sorted((r.question, r.answer_type) for r in rejected.collect()) == [("q1", "poem"), ("q9", "normal")]


def test_model_without_settings(spark, rubrics, settings, observations):
    log = answers(spark, answer("q1", "splendid"), answer("q1", "x", model="three"))
    verdicts, rejected = judge_answers(log, settings, rubrics, observations, lambda: judge, "Oulu", mode="quarantine")
    assert [r.model for r in verdicts.collect()] == ["one"] and [r.model for r in rejected.collect()] == ["three"]
    with pytest.raises(Exception, match="no entry for .model. = three"):
        judge_answers(log, settings, rubrics, observations, lambda: judge, "Oulu")[0].collect()


def test_similarity_graded_by_a_model(spark, rubrics, settings, observations):
    def grade(request):
        assert "Reference: the true words" in request.user_text or f"Reference: {WEATHER}" in request.user_text
        assert request.endpoint == "grader"
        return Reply(text="**Score:** 3\n**Explanation:** close")

    log = answers(spark, answer("q_rag", "words", "rag"), answer("q_function", None, "function"))
    graded = settings.withColumn("similarity_endpoint", F.lit("grader"))
    verdicts, _ = judge_answers(
        log, graded, rubrics, observations, lambda: judge, "Oulu", similarity_factory=lambda: grade
    )
    assert [(r.score, r.explanation) for r in verdicts.collect()] == [("3", "close")] * 2


def test_only_new_answers(spark, rubrics, settings, observations):
    log = answers(spark, answer("q1", "splendid"), answer("q2", "dull"))
    verdicts, _ = judge_answers(log, settings, rubrics, observations, lambda: judge, "Oulu")
    done = verdicts.where("question = 'q1'")
    rest, _ = judge_answers(log, settings, rubrics, observations, lambda: judge, "Oulu", results=done)
    assert [r.question for r in rest.collect()] == ["q2"]


def test_truths_by_key(spark):
    rows = [("one", "rag", "a b"), ("one", "function", "a"), ("two", "rag", None)]
    df = spark.createDataFrame(rows, "model string, answer_type string, ai_output string")
    truths = spark.createDataFrame(
        [("one", "rag", "a b"), ("one", "function", "z"), ("two", "rag", "x")], schemas.GROUND_TRUTH
    )
    verdicts, _ = judge_by_similarity(df, truths)
    got = {(r.model, r.answer_type): r.score for r in verdicts.collect()}
    assert got == {("one", "rag"): "5", ("one", "function"): "1", ("two", "rag"): None}


def test_rubric_needs_five_levels():
    with pytest.raises(ValueError):
        rubric_template("x", LEVELS[:4])


def test_broadcast_only_when_measured_small(spark):
    small = spark.range(10).select(F.col("id").cast("string"))
    assert "ResolvedHint" in broadcast_if_small(small)._jdf.queryExecution().toString()
    assert "ResolvedHint" not in broadcast_if_small(small, rows=9)._jdf.queryExecution().toString()
    assert "ResolvedHint" not in broadcast_if_small(small, size=20)._jdf.queryExecution().toString()


def test_look_up_rejects_keys_with_several_entries(spark):
    facts = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    dimension = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), (None, 3)], "k string, v int")
    known, rejected = look_up(facts, dimension, ["k"], "quarantine")
    assert known.collect() == [("a", 1)] and {r.k for r in rejected.collect()} == {"b", None}
    with pytest.raises(Exception, match="several entries"):
        look_up(facts.where("k = 'b'"), dimension, ["k"])[0].collect()


def test_answers_without_a_question(spark):
    df = spark.createDataFrame([(None, 1), ("q0", 2), ("q1", 3)], "question string, n int")
    assert {r.n for r in to_judge(df).collect()} == {1, 3}
    assert {r.n for r in not_yet_judged(df, df.where("n < 3").select("question"), ["question"]).collect()} == {3}


def test_one_time_of_many_tool_answers_is_looked_up_once(spark, observations):
    log = answers(spark, *[answer("q_function", str(i), "function") for i in range(50)])
    assert [r.truth for r in tool_truths(log, observations, "Oulu").collect()] == [WEATHER] * 50


def test_look_up_without_broadcast_still_rejects(spark, monkeypatch):
    import askmill.operators.dimensions as module

    monkeypatch.setattr(module, "broadcast_if_small", lambda df: df)
    facts = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    known, rejected = look_up(facts, spark.createDataFrame([("a", 1)], "k string, v int"), ["k"], "quarantine")
    assert [r.k for r in known.collect()] == ["a"]
    assert sorted(str(r.k) for r in rejected.collect()) == ["None", "b"]
    with pytest.raises(ValueError):
        look_up(facts, facts, ["k"], "ignore")


def test_latest_keeps_one_row_per_key_before_the_shuffle(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "w")], "k string, t int, v string")
    newest = latest_per_key(log, ["k"], [F.col("t").desc()])
    assert sorted(r.v for r in newest.collect()) == ["w", "z"]
    assert "WindowGroupLimit" in newest._jdf.queryExecution().toString()
