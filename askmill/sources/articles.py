"""Raw articles: one text file is one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_articles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(doc_id, text)`` with the file name as ``doc_id``; files are UTF-8."""
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text")
    )
