import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from askmill import schemas
from askmill.operators.clients import ExtractiveStub, LengthJudgeStub
from askmill.operators.judge import rubric_template, rubrics_table
from askmill.plans import episode
from askmill.session import materialise, scratch_path
from askmill.sources.articles import read_articles
from askmill.sources.configs import answer_settings, index_settings, judge_settings, question_rows, read_configs
from askmill.sources.tables import TableSet, append_table, check_targets, drop_table, overwrite_table

QUESTIONS = {
    "q0": "Who are you?",
    "q1": "What’s your song?",
    "q_rag": "Do Herons eat frogs ?",
    "q_function": "Weather in Oulu?",
}


def config(model, **extra):
    return {
        "configs": {
            "model_name": model,
            "vector_search_endpoint_name": "search",
            "embedding_endpoint": "hashing",
            "endpoint": "local",
            "extra_params": {"max_tokens": 400, "temperature": 0.7},
            "system_prompt": "Be kind.",
            "rag_prompt": "{context} / Asked: {question} / Reply:",
            **extra,
        },
        "questions": QUESTIONS,
        "judge_configs": {
            "databricks_endpoint": "judge",
            "openai_endpoint": "judge",
            "extra_params": {"max_tokens": 250, "temperature": 0.1},
        },
        "judge_prompts": {
            "rag_prompt": "Do Herons eat frogs ?",
            "rag_ground_truth": "Herons eat frogs",
            "function_prompt": "Weather?",
            "normal_system_prompt": "Judge.",
        },
    }


@pytest.fixture
def configs(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(config("one"), indent=1), "utf-8")
    (tmp_path / "two.json").write_text(json.dumps(config("two", kv_scope="s", kv_secret="k")), "utf-8")
    return read_configs(spark, [str(tmp_path / "one.json"), str(tmp_path / "two.json")])


def test_articles(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Line\none’s\r\nend\n", "utf-8", newline="")
    (tmp_path / "b.txt").write_text("", "utf-8")
    got = {r.doc_id: r.text for r in read_articles(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "Line\none’s\r\nend\n" and got.get("b.txt", "") == ""


def test_configs_with_and_without_optional_fields(configs):
    rows = {r.configs.model_name: r for r in configs.collect()}
    assert rows["one"].configs.kv_scope is None and rows["two"].configs.kv_scope == "s"
    assert judge_settings(configs).first().judge_params.max_tokens == 250
    assert index_settings(configs).first().embedding_endpoint == "hashing"


def test_questions_in_file_order(configs):
    rows = question_rows(answer_settings(configs)).orderBy("model", "pos").collect()
    assert [(r.question, r.input_prompt) for r in rows] == list(QUESTIONS.items()) * 2


def test_shared_questions_for_all_models(configs):
    rows = question_rows(answer_settings(configs), {"q1": "A?", "q2": "B?"}).orderBy("model", "pos").collect()
    assert [(r.model, r.question) for r in rows] == [("one", "q1"), ("one", "q2"), ("two", "q1"), ("two", "q2")]


@pytest.fixture
def schema(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS evals")
    yield "evals"
    spark.sql("DROP DATABASE evals CASCADE")


def test_preconditions(spark, schema):
    names = TableSet("spark_catalog", schema, "t")
    check_targets(spark, names)
    with pytest.raises(ValueError, match="empty"):
        TableSet("spark_catalog", schema, "")
    with pytest.raises(ValueError, match="catalog 'nowhere'"):
        check_targets(spark, TableSet("nowhere", schema, "t"))
    with pytest.raises(ValueError, match="schema 'missing'"):
        check_targets(spark, TableSet("spark_catalog", "missing", "t"))
    overwrite_table(spark.range(3), names.chunks)
    with pytest.raises(ValueError, match="t_rag_data' exists"):
        check_targets(spark, names)


def test_sinks(spark, schema):
    name = f"spark_catalog.{schema}.sink"
    overwrite_table(spark.range(3), name)
    overwrite_table(spark.range(2).select(F.col("id").cast("string").alias("other")), name)
    assert spark.read.table(name).columns == ["other"]
    drop_table(spark, name)
    for _ in range(2):
        append_table(spark.range(2).withColumn("model", F.lit("one")), name, ("model",))
    assert spark.read.table(name).count() == 4


def test_scratch_lies_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.askmill.scratch", None)
    path = scratch_path(spark, "x")
    assert path.startswith(f"{root}/x-") if root else "/askmill-" in path
    assert scratch_path(spark, "x") != path


def test_materialised_rows_are_fixed(spark):
    df = materialise(spark.range(3).withColumn("r", F.rand()), "r")
    assert df.collect() == df.collect()


def test_whole_episode(spark, configs, schema):
    names = TableSet("spark_catalog", schema, "birds")
    text = "Herons eat frogs " * 60 + " ".join(f"word{i}" for i in range(223))
    documents = spark.createDataFrame([("herons", text), ("songs", "Songs are sung")], "doc_id string, text string")
    condition = {"current_condition": [{"temp_C": "20", "weatherDesc": [{"value": "Sun"}]}]}
    observations = spark.createDataFrame([("Oulu", dt.datetime(2024, 6, 1), json.dumps(condition))], schemas.OBSERVATIONS)
    rubrics = rubrics_table(spark, {"q1": rubric_template("a critic", ["a", "b", "c", "d", "e"])})

    def run():
        return episode.run_episode(
            spark,
            names,
            documents,
            configs,
            rubrics,
            observations,
            lambda: ExtractiveStub(3),
            LengthJudgeStub,
            ["one", "two"],
            "Oulu",
        )

    report = run()
    rows = {r[0]: r for r in report.collect()}
    assert list(rows) == [
        "Q0 - Who are you?",
        "Q1 - What’s your song?",
        "Q_FUNCTION - Weather in Oulu?",
        "Q_RAG - Do Herons eat frogs ?",
        "Overall situation:",
        " Avg Speed:",
    ][1:]
    assert rows["Q_RAG - Do Herons eat frogs ?"]["one"] == "5" and rows["Q_FUNCTION - Weather in Oulu?"]["two"] == "❌"
    answers = spark.read.table(names.answers)
    assert answers.count() == 8 and set(answers.columns) == set(schemas.ANSWERS.replace(",", "").split()[0::2])
    assert spark.read.table(names.chunks).count() == 4
    assert episode.create_chunks(spark, TableSet("spark_catalog", schema, "other"), documents) == 4

    # A second run is refused; judging again takes only what is new.
    with pytest.raises(ValueError):
        run()
    arguments = (spark, names, configs, rubrics, observations, LengthJudgeStub, "Oulu")
    episode.create_verdicts(*arguments, incremental=True)
    assert spark.read.table(names.results).count() == 6
    episode.create_verdicts(*arguments)
    assert spark.read.table(names.results).count() == 12
