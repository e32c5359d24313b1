"""Table names, preconditions, reads and writes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class TableSet:
    """The tables of one evaluation, all derived from ``catalog.schema.table``."""

    catalog: str
    schema: str
    table: str

    def __post_init__(self) -> None:
        if not (self.catalog and self.schema and self.table):
            raise ValueError("catalog, schema and table must not be empty")

    def _name(self, suffix: str) -> str:
        return f"{self.catalog}.{self.schema}.{self.table}_{suffix}"

    @property
    def chunks(self) -> str:
        return self._name("rag_data")

    @property
    def index(self) -> str:
        return self._name("index")

    @property
    def answers(self) -> str:
        return self._name("inference_table")

    @property
    def results(self) -> str:
        return self._name("results")

    @property
    def all(self) -> tuple[str, ...]:
        return (self.chunks, self.index, self.answers, self.results)


def check_targets(spark: SparkSession, names: TableSet) -> None:
    """Catalog and schema must exist, and none of the tables may.

    Every derived name is looked up on its own; no listing is collected. A
    session knows a catalog only once it is used, so the catalog is asked for
    the schema rather than searched in a list.
    """
    if spark.conf.get(f"spark.sql.catalog.{names.catalog}", None) is None and names.catalog != "spark_catalog":
        raise ValueError(f"catalog '{names.catalog}' does not exist")
    if not spark.catalog.databaseExists(f"{names.catalog}.{names.schema}"):
        raise ValueError(f"schema '{names.schema}' in catalog '{names.catalog}' does not exist")
    for name in names.all:
        if spark.catalog.tableExists(name):
            raise ValueError(f"table '{name}' exists already")


def overwrite_table(df: DataFrame, name: str) -> None:
    """Replace a table, its schema included."""
    df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(name)


def append_table(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> None:
    """One append for the whole batch; a failed job leaves no rows behind."""
    df.write.mode("append").partitionBy(*partition_by).saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
