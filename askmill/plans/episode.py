"""A whole evaluation from articles to report, phase by phase over stored tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from askmill.functions.vectors import HashingEmbedder
from askmill.operators.chunks import chunk_documents
from askmill.operators.clients import Client
from askmill.operators.report import comparison
from askmill.operators.tools import weather_tool
from askmill.operators.vectors import build_index
from askmill.plans.answers import answer_questions, log_answers
from askmill.plans.judging import judge_answers
from askmill.sources.configs import answer_settings, judge_settings, question_rows
from askmill.sources.tables import TableSet, append_table, check_targets, overwrite_table


def create_chunks(spark: SparkSession, names: TableSet, documents: DataFrame, single_document: bool = False) -> int:
    """Write the chunk table; returns the number of chunks, counted while writing."""
    counted = Observation()
    chunks = chunk_documents(documents, single_document=single_document)
    overwrite_table(chunks.observe(counted, F.count(F.lit(1)).alias("n")), names.chunks)
    return counted.get["n"]


def create_index(spark: SparkSession, names: TableSet, embedder) -> None:
    overwrite_table(build_index(spark.read.table(names.chunks), embedder), names.index)


def create_answers(
    spark: SparkSession,
    names: TableSet,
    configs: DataFrame,
    observations: DataFrame,
    client_factory: Callable[[], Client],
    embedder,
    k: int = 4,
    parallelism: int | None = None,
    requests_per_second: float | None = None,
) -> None:
    answers = answer_questions(
        question_rows(answer_settings(configs)),
        spark.read.table(names.index),
        client_factory,
        [weather_tool(observations)],
        embedder,
        k,
        parallelism=parallelism,
        requests_per_second=requests_per_second,
    )
    log_answers(answers, names.answers)


def create_verdicts(
    spark: SparkSession,
    names: TableSet,
    configs: DataFrame,
    rubrics: DataFrame,
    observations: DataFrame,
    judge_factory: Callable[[], Client],
    city: str,
    incremental: bool = False,
    parallelism: int | None = None,
    requests_per_second: float | None = None,
    similarity_factory: Callable[[], Client] | None = None,
) -> None:
    """Append verdicts; ``incremental`` leaves out answers that have one.

    With ``similarity_factory`` a model grades how far answers agree with their
    truths, else the words they share decide.
    """
    judged = spark.catalog.tableExists(names.results)
    verdicts, _ = judge_answers(
        spark.read.table(names.answers),
        judge_settings(configs),
        rubrics,
        observations,
        judge_factory,
        city,
        results=spark.read.table(names.results) if incremental and judged else None,
        similarity_factory=similarity_factory,
        parallelism=parallelism,
        requests_per_second=requests_per_second,
    )
    append_table(verdicts, names.results, partition_by=("model",))


def run_episode(
    spark: SparkSession,
    names: TableSet,
    documents: DataFrame,
    configs: DataFrame,
    rubrics: DataFrame,
    observations: DataFrame,
    client_factory: Callable[[], Client],
    judge_factory: Callable[[], Client],
    models: Sequence[str],
    city: str,
    embedder=None,
    single_document: bool = False,
    similarity_factory: Callable[[], Client] | None = None,
    parallelism: int | None = None,
    requests_per_second: float | None = None,
) -> DataFrame:
    """All phases for all configs at once; returns the report.

    ``parallelism`` and ``requests_per_second`` hold for answers and verdicts.

    Each phase reads the table the one before it wrote, so a run that stops can
    go on from its last table by calling the remaining phases.
    """
    embedder = embedder or HashingEmbedder()
    check_targets(spark, names)
    create_chunks(spark, names, documents, single_document)
    create_index(spark, names, embedder)
    paced = {"parallelism": parallelism, "requests_per_second": requests_per_second}
    create_answers(spark, names, configs, observations, client_factory, embedder, **paced)
    create_verdicts(
        spark, names, configs, rubrics, observations, judge_factory, city, similarity_factory=similarity_factory, **paced
    )
    return comparison(spark.read.table(names.results), models)
