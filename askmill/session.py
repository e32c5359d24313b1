"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_session(app: str = "askmill", cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for local runs; on a cluster, submit with your own settings."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return ship_package(builder.getOrCreate())


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of ``spark``, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="askmill-zip-"), "askmill")
        archive = shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for intermediate tables, in the cluster's shared folder.

    ``spark.checkpoint.dir`` names that folder. Only when it is unset, as in
    local tests, a machine-local folder is used and remembered.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.askmill.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="askmill-")
        spark.conf.set("spark.askmill.scratch", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used behind model calls, which must not run again when the result feeds
    more than one branch, and which an executor loss must not repeat for rows
    that are already stored.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
