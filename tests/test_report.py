import datetime as dt

import pytest
from pyspark.sql import functions as F

from askmill import schemas
from askmill.operators.report import averages, comparison, model_report, relabelled

NOW = dt.datetime(2024, 7, 1)


def verdict(question, score, seconds, model="one", inserted=NOW, prompt=None):
    return ("out", question, prompt or f"ask {question}", seconds, model, "normal", inserted, False, None, score, "why", None)


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        verdict("q2", "4", 1.5),
        verdict("q1", "3", 2.75),
        verdict("q_rag", "5", 4.0),
        verdict("q_function", "1", 9.99),
        verdict("q1", "2", 1.0, "two"),
        verdict("q1", "5", 3.0, "two", NOW + dt.timedelta(hours=1)),
        verdict("q2", "None", 2.0, "two"),
    ]
    return spark.createDataFrame(rows, schemas.VERDICTS)


def test_one_model(results):
    report = model_report(results, "one", placeholders=["Model 2"])
    assert report.columns == ["Questions", "one", "one speed", "Model 2"]
    assert [tuple(r) for r in report.collect()] == [
        ("Q1 - ask q1", "3", "2.75s", ""),
        ("Q2 - ask q2", "4", "1.5s", ""),
        ("Q_FUNCTION - ask q_function", "❌", "9.99s", ""),
        ("Q_RAG - ask q_rag", "5", "4.0s", ""),
        ("Overall situation:", "4.0", "", ""),
        (" Avg Speed:", "2.75s", "", ""),
    ]


def test_truncated_averages_over_all_questions(results):
    report = model_report(results, "one", exclude=(), truncate=True, mask=())
    rows = [tuple(r) for r in report.collect()]
    assert rows[-2:] == [("Overall situation:", "3.25", ""), (" Avg Speed:", "4.0s", "")]
    assert rows[2] == ("Q_FUNCTION - ask q_function", "1", "9.99s")


def test_unreadable_scores_are_left_out_and_counted(results):
    row = averages(results.where("model = 'two'")).first()
    assert (row.avg_score, row.avg_speed, row.n_unscored) == ("3.5", "2.0s", 1)


def test_side_by_side_counts_the_newest_answer(results):
    report = comparison(results, ["one", "two", "three"])
    assert report.columns == ["Questions", "one", "one speed", "two", "two speed", "three", "three speed"]
    rows = {r[0]: tuple(r)[1:] for r in report.collect()}
    assert rows["Q1 - ask q1"] == ("3", "2.75s", "5", "3.0s", "", "")
    assert rows["Overall situation:"] == ("4.0", "", "5.0", "", "", "")
    assert list(rows)[-1] == " Avg Speed:"


def test_display_names(results):
    shown = relabelled(results, {"q_rag": "RAG"}).where("model = 'one'")
    assert [r.question for r in shown.collect()] == ["RAG", "q1", "q2", "q_function"]
    unnamed = relabelled(results).where(F.col("model") == "one")
    assert [r.question for r in unnamed.collect()] == ["q1", "q2", "q_function", "q_rag"]


def test_missing_score_is_blank(spark):
    rows = spark.createDataFrame([verdict("q1", None, 1.0)], schemas.VERDICTS)
    assert model_report(rows, "one").first()["one"] == ""
