"""Exact nearest chunks with index blocks clustered by direction, skipped by angle bounds.

The index is dealt into clusters around ``clusters`` seed vectors (those of
least hash of id: a bounded sample, the only rows the driver sees), each
cluster into blocks of at most ``budget`` bytes. A block knows its centroid
(the seed) and its radius, the greatest angle of a member from it. Angles
between unit vectors obey the triangle rule, so a question at angle ``t``
from a centroid meets no member of the block above ``cos(max(0, t - r))`` and
every member at least at ``cos(min(pi, t + r))``. The lower bounds of its
blocks, summed by their counts, give a floor that its ``k``-th best reaches;
a block whose upper bound is under that floor holds none of its hits. A work
item (question block, index block) is left out when all its questions can
leave the block out, and the others run as in :func:`nearest`.

Vectors without length have no direction: they are kept in blocks of their
own that no question skips, and questions without length skip nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askmill.operators.retrieve import QUERY_BUDGET, _blocked, run_items
from askmill.session import materialise, scratch_path

#: Bounds are compared with this much room, far above the error of double precision.
MARGIN = 1e-7


def _cosines(seeds: np.ndarray, vectors: pa.ListArray, norms: np.ndarray) -> np.ndarray:
    """Cosine of each row with each seed; rows without length give NaN."""
    width = seeds.shape[1]
    flat = np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), width)
    safe = np.where(norms > 0, norms, 1.0)
    out = np.clip((flat / safe[:, None]) @ seeds.T, -1.0, 1.0)
    out[~(norms > 0)] = np.nan
    return out


def _assign(seeds: np.ndarray, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("embedding").is_valid())
            norms = np.asarray(batch.column("norm").fill_null(0.0), dtype=np.float64)
            cos = _cosines(seeds, batch.column("embedding"), norms) if batch.num_rows else np.zeros((0, len(seeds)))
            if key == "id":
                has = norms > 0
                nearest = np.where(has, np.argmax(np.nan_to_num(cos, nan=-2.0), axis=1), -1) if batch.num_rows else np.zeros(0, int)
                best = np.where(has, cos[np.arange(len(cos)), np.maximum(nearest, 0)], np.nan) if batch.num_rows else np.zeros(0)
                extra = [pa.array(nearest.astype(np.int32)), pa.array(best, mask=~has)]
                names = ["cluster", "cos"]
            else:
                # One more place: the cluster of vectors without length, which no bound leaves out.
                cos = np.hstack([cos, np.full((len(cos), 1), np.nan)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cos) + 1, dtype=np.int32) * (len(seeds) + 1)), pa.array(cos.ravel()))
                extra, names = [lists], ["cosines"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

    return run


def nearest_clustered(queries: DataFrame, index: DataFrame, k: int = 4, clusters: int = 64, budget: int = QUERY_BUDGET):
    """``(hits, kept, total)``: the hits of :func:`nearest`, and work items run and possible."""
    spark = index.sparkSession
    asked = queries.select("query_id", "embedding", "norm")
    source = index.select("id", "embedding", "norm")
    seed_rows = (
        source.where(F.col("embedding").isNotNull() & (F.col("norm") > 0))
        .orderBy(F.xxhash64("id"), "id")
        .limit(clusters)
        .collect()
    )  # at most ``clusters`` vectors
    if not seed_rows:
        from askmill.operators.retrieve import nearest

        hits = nearest(queries, index, k, None, budget)
        return hits, None, None
    seeds = np.stack([np.asarray(r["embedding"], dtype=np.float64) / r["norm"] for r in seed_rows])
    dim = seeds.shape[1]
    schema = T.StructType([*source.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("cos", T.DoubleType())])
    placed = materialise(source.mapInArrow(_assign(seeds, "id"), schema), "clustered-index")
    counts = {r["cluster"]: r["n"] for r in placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, subs = {}, {}
    at = 0
    for cluster in sorted(counts):
        subs[cluster] = max(1, -(-counts[cluster] * dim * 8 // budget))
        first[cluster] = at
        at += subs[cluster]
    table = spark.createDataFrame([(c, first[c], subs[c]) for c in sorted(counts)], "cluster int, first long, subs long")
    place = F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())
    blocked = materialise(
        placed.join(F.broadcast(table), "cluster").withColumn("block", F.col("first") + F.pmod(place, F.col("subs"))).drop("first", "subs"),
        "clustered-blocks",
    )
    lengthless = F.lit(len(seeds))
    stats = blocked.groupBy("block", F.when(F.col("cluster") < 0, lengthless).otherwise(F.col("cluster")).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.min("cos").alias("low_cos")
    )
    stats = stats.withColumn("radius", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "low_cos"))))
    questions, q_blocks, n_queries = _blocked(asked, budget, dim)
    questions = materialise(questions, "clustered-questions")
    q_schema = T.StructType([*questions.schema.fields, T.StructField("cosines", T.ArrayType(T.DoubleType()))])
    angled = questions.mapInArrow(_assign(seeds, "query_id"), q_schema).select(
        "query_id", F.col("block").alias("q_block"), "norm", F.posexplode("cosines").alias("cluster", "q_cos")
    )
    theta = F.acos(F.col("q_cos"))
    apart = F.col("cluster") == lengthless
    bounds = angled.join(stats, "cluster").select(
        "query_id",
        "q_block",
        "norm",
        F.col("block").alias("i_block"),
        "n",
        F.when(apart, 2.0).otherwise(F.cos(F.greatest(F.lit(0.0), theta - F.col("radius")))).alias("up"),
        F.when(apart, -2.0).otherwise(F.cos(F.least(F.lit(math.pi), theta + F.col("radius")))).alias("low"),
    )
    by_low = Window.partitionBy("query_id").orderBy(F.col("low").desc(), "i_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = bounds.withColumn("count", F.sum("n").over(by_low))
    floor = reached.where(F.col("count") >= k).groupBy("query_id").agg(F.max("low").alias("floor"))
    needed = (
        bounds.join(floor, "query_id", "left")
        .where(F.col("floor").isNull() | ~(F.col("norm") > 0) | (F.col("up") >= F.col("floor") - MARGIN))
        .select("q_block", "i_block")
    )
    path = scratch_path(spark, "clustered-items")
    needed.distinct().withColumn("item", F.col("q_block") * F.lit(at) + F.col("i_block")).write.parquet(path)
    kept = spark.read.parquet(path).count()
    total = q_blocks * at
    out = T.StructType(
        [T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("id", source.schema["id"].dataType), T.StructField("sim", T.DoubleType())]
    )
    if kept == 0:
        return spark.createDataFrame([], out).withColumn("rank", F.lit(0)).select("query_id", "rank", "id", "sim"), kept, total

    def items(side: str):
        return spark.read.parquet(path).select("item", f"{side}_block")

    hits = run_items(questions, blocked.select("id", "embedding", "norm", "block"), items, k, out)
    return hits, kept, total
