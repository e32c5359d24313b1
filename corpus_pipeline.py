"""A corpus pipeline: quality rules, toxicity, near-duplicates, packing.

Every stage takes all documents that its predecessor kept, and all but the last
return the columns of ``documents``. ``run`` writes each stage's rows to the
shared scratch folder and reads them back for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.llm import byte_bpe, minhash, packing, quality, toxicity
from askmill.llm.queries import BYTE_BPE, held_out
from askmill.operators.dimensions import broadcast_if_small
from askmill.session import materialise, ship_package

#: Ids up to this many, and as many bytes as ``broadcast_if_small`` allows, are sent to all tasks to leave out their rows.
SENT_IDS = 1_000_000
#: Words that a worker remembers the ids of in packing: fewer than a query of its own may, since the executors carry the stages before.
WORDS = 100_000
#: Rows that are handed to Python at a time, unless the session says otherwise: all stages hand over whole texts.
BATCH = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package, and keep the batches small that tasks hold in the JVM and in Python."""
    ship_package(spark)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host is not rejected."""
    prepare(spark)
    return quality.judge_documents(docs, host="source").where("kept").select(*docs.columns)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as not toxic, by a model of the labels that may be learned."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = toxicity.with_score(docs, toxicity.fit(docs, labels), score="__score")
    return scored.where(F.col("__score") < toxicity.TOXIC).select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id; of rows with one id, that with the least hash of its text."""
    prepare(spark)
    found = materialise(minhash.near_duplicates(docs, words=5, percent=80), "near-duplicates")
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    rest = docs.join(broadcast_if_small(dropped, rows=SENT_IDS), "doc_id", "left_anti")
    repeated = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return rest.select(*docs.columns)
    repeated = broadcast_if_small(repeated, rows=SENT_IDS)
    several = rest.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row"))
    return rest.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(several.select("row.*"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    prepare(spark)
    return packing.pack(docs, byte_bpe.load_tokenizer(public_tokenizers.path(BYTE_BPE)), capacity=1024, end_id=2, words=WORDS)


STAGES = [
    ("quality_rules", keep_quality),
    ("toxicity", keep_civil),
    ("minhash_near_dedup", keep_distinct),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
