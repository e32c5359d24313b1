"""Triggered sync of the vector index with a feed of chunk changes.

A change feed is a folder of parquet files with ``id, text, op, seq``: ``op`` is
``upsert`` or ``delete`` and ``seq`` grows with every change. A sync takes in
what is new since the last one and stops. The index is a folder of versions,
one per micro-batch, and readers take the newest version of each id. A change
that alters nothing leaves a small ``touch`` row without text and vector, and a
deletion of an unknown id a tombstone, so that an older change that comes later
is still known to be older.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill import schemas
from askmill.operators.dimensions import broadcast_if_small
from askmill.operators.latest import latest_per_key
from askmill.operators.vectors import embed
from askmill.session import materialise

# Ids of changes are broadcast up to this many, if they are small enough as well.
BROADCAST_IDS = 1_000_000

VERSIONS = schemas.VECTORS + ", op string, seq bigint, version bigint"


def _digest(text: str) -> Column:
    """SHA-256 in half the bytes of its hex form, for shuffles."""
    return F.unhex(F.sha2(text, 256))


def chunk_changes(before: DataFrame, after: DataFrame, seq: Column | int) -> DataFrame:
    """The change rows that lead from one state of the chunk table to another."""
    old = before.select("id", _digest("text").alias("old_hash"))
    # Digests of the new texts are taken behind the shuffle, which carries the texts anyway.
    new = after.select("id", "text")
    gone = F.col("text").isNull()
    return (
        old.join(new, "id", "full_outer")
        .where(~F.col("old_hash").eqNullSafe(_digest("text")))
        .select(
            "id",
            "text",
            F.when(gone, "delete").otherwise("upsert").alias("op"),
            (seq if isinstance(seq, Column) else F.lit(seq)).cast("bigint").alias("seq"),
        )
    )


def publish_changes(changes: DataFrame, feed: str) -> None:
    changes.select("id", "text", "op", "seq").write.mode("append").option("compression", "zstd").parquet(feed)


def _folder(spark: SparkSession, path: str):
    """File system and path object; Spark's Python API has none of its own."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target  # noqa: SLF001


def _versions(spark: SparkSession, index: str) -> DataFrame:
    files, target = _folder(spark, index)
    if files.exists(target):
        return spark.read.schema(VERSIONS).parquet(index)
    # A constant filter tells the optimizer that this is empty, so joins with it vanish.
    return spark.createDataFrame([], VERSIONS).where(F.lit(False))


def _newest(spark: SparkSession, index: str) -> DataFrame:
    """Newest version of each id with what it holds, tombstones included.

    Within a version ids are unique. The first version is the large one, and it
    is not shuffled: only the ids and rows of the versions after it are, and
    those ids are taken out of the first version.
    """
    stored = _versions(spark, index)
    first = stored.agg(F.min("version")).first()[0]
    if first is None:
        return stored
    base = stored.where(F.col("version") == first)
    # The first version has nothing that it could touch.
    later = stored.where((F.col("version") > first) & (F.col("op") != "touch"))
    if later.isEmpty():
        return base
    replaced = broadcast_if_small(later.select("id"), rows=BROADCAST_IDS)
    return base.join(replaced, "id", "left_anti").unionByName(
        latest_per_key(later, ["id"], [F.col("version").desc()])
    )


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """The live vectors: newest version of each id, deleted ones left out."""
    return _newest(spark, index).where(F.col("op") != "delete").drop("op", "seq", "version")


def compact_index(spark: SparkSession, index: str, target: str) -> None:
    """Write all versions of an index as the one first version of another.

    The version is below any micro-batch's, so a sync can go on with the same
    checkpoint on ``target``, even with a batch that ``index`` holds already.
    """
    touched = _versions(spark, index).where("op = 'touch'").groupBy("id").agg(F.max("seq").alias("_touched"))
    newest = _newest(spark, index).join(touched, "id", "left").withColumn("seq", F.greatest("seq", "_touched"))
    columns = [f.split()[0] for f in VERSIONS.split(", ")]
    newest.withColumn("version", F.lit(-1).cast("bigint")).select(*columns).write.option("compression", "zstd").partitionBy("version").parquet(target)


def _decide(changes: DataFrame, stored: DataFrame) -> DataFrame:
    """``(id, n, seq, op, digest, fate)``: the last of the ``n`` changes of each id, and whether it is news, a touch or late.

    Texts take no part: a change goes by the digest of its text.
    """
    marks = changes.select("id", "seq", "op", _digest("text").alias("digest"))
    last = marks.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("seq", "op", "digest")).alias("last"))
    # Only the stored rows whose id changes; text and vectors are not read.
    ids = broadcast_if_small(changes.select("id"), rows=BROADCAST_IDS)
    touched = stored.select("id", "version", "op", "seq", F.unhex("content_hash").alias("digest")).join(ids, "id", "left_semi")
    held = F.when(F.col("op") != "touch", F.struct("version", "op", "digest"))
    state = touched.groupBy("id").agg(F.max("seq").alias("stored_seq"), F.max(held).alias("held"))
    same_text = (F.col("held.op") == "upsert") & F.col("digest").eqNullSafe(F.col("held.digest"))
    alters_nothing = F.when(F.col("op") == "delete", F.col("held.op") == "delete").otherwise(same_text)
    is_new = F.col("stored_seq").isNull() | (F.col("seq") > F.col("stored_seq"))
    fate = F.when(~F.coalesce(is_new, F.lit(False)), "late").when(alters_nothing, "touch").otherwise("news")
    return last.select("id", "n", "last.*").join(state, "id", "left").select("id", "n", "seq", "op", "digest", fate.alias("fate"))


def _news(changes: DataFrame, stored: DataFrame) -> DataFrame:
    """``(id, text, content_hash, op, seq)`` of the changes that count, touches without their text.

    Which changes count is decided on digests. A change that is the only one of
    its id and alters something goes on from where it was read; so texts are
    shuffled only if ids repeat, or if too many ids are touched or late to be
    sent to all tasks.
    """
    odd = materialise(_decide(changes, stored).where("n > 1 or fate != 'news'"), "odd-changes")
    odd_rows = odd.agg(F.sum("n")).first()[0] or 0
    repeated = odd.where("n > 1 and fate = 'news'").select(F.col("id").alias("_id"))
    same_id = F.col("id").eqNullSafe(F.col("_id"))
    touches = odd.where("fate = 'touch'").select(
        "id", F.lit(None).cast("string").alias("text"), F.lower(F.hex("digest")).alias("content_hash"), F.lit("touch").alias("op"), "seq"
    )
    parts = []
    if odd_rows == 0:
        parts.append(changes)
    elif odd_rows < changes.count():
        parts.append(changes.join(broadcast_if_small(odd.select(F.col("id").alias("_id")), rows=BROADCAST_IDS), same_id, "left_anti"))
    if not repeated.isEmpty():
        several = changes.join(broadcast_if_small(repeated, rows=BROADCAST_IDS), same_id, "left_semi").withColumn("_digest", _digest("text"))
        newest = [F.col("seq").desc(), F.col("op").desc(), F.col("_digest").desc_nulls_last()]
        parts.append(latest_per_key(several, ["id"], newest))
    whole = [part.select("id", "text", F.sha2("text", 256).alias("content_hash"), "op", "seq") for part in parts]
    shown = [part.withColumn("text", F.when(F.col("op") == "upsert", F.col("text"))) for part in whole]
    return reduce(DataFrame.unionByName, [touches, *shown])


def apply_changes(changes: DataFrame, version: int, index: str, embedder=None) -> None:
    """Write one micro-batch as a version of its own.

    Only versions before this one count as stored, and a version that exists is
    replaced, so a batch that is run again leaves the same result. Of several
    changes to an id the last counts, and of those at one place in the feed always
    the same; changes that come late are dropped before anything is embedded, and
    of those that equal the stored state only their place in the feed is kept.
    """
    news = _news(changes, _versions(changes.sparkSession, index).where(F.col("version") < version))
    # Other rows have no text; they pass the embedder and lose the vector of nothing.
    live = F.col("op") == "upsert"
    (
        embed(news, "text", embedder)
        .withColumns({"embedding": F.when(live, F.col("embedding")), "norm": F.when(live, F.col("norm"))})
        .withColumn("version", F.lit(version).cast("bigint"))
        .select("id", "text", "embedding", "norm", "content_hash", "op", "seq", "version")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("version")
        .parquet(index)
    )


def sync_index(
    spark: SparkSession, feed: str, index: str, checkpoint: str, embedder=None, max_files: int | None = None
) -> None:
    """Take in all changes published since the last sync, then stop.

    ``max_files`` bounds what one micro-batch takes in; the sync then runs as
    many as it needs.
    """
    reader = spark.readStream.schema(schemas.CHANGES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    changes = reader.parquet(feed)
    query = (
        changes.writeStream.foreachBatch(lambda batch, version: apply_changes(batch, version, index, embedder))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drop_index(spark: SparkSession, *paths: str) -> None:
    """Delete index and checkpoint folders, so that the next sync starts afresh."""
    for path in paths:
        files, target = _folder(spark, path)
        files.delete(target, True)
