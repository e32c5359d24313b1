"""The operators as queries over the given tables.

``documents`` is the corpus, ``benchmark`` and the user turns of
``conversations`` are questions, assistant turns are answers, ``embeddings`` is
a vector index and ``events`` stands in for an answer log.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askmill.functions import chat
from askmill.functions.text import render, words
from askmill.functions.vectors import HashingEmbedder, vector_norm, word_bucket
from askmill.operators.asof import latest_before
from askmill.operators.chunks import chunk_documents, chunk_lengths
from askmill.operators.clients import EchoStub, LengthJudgeStub
from askmill.operators.generate import generate
from askmill.operators.judge import (
    judge_by_similarity,
    rubric_prompts,
    rubric_template,
    rubrics_table,
    to_judge,
    with_verdict,
)
from askmill.operators.latest import latest_per_key, not_yet_judged
from askmill.operators.report import averages, comparison, model_report, relabelled, report_rows
from askmill.operators.clustered import nearest_clustered
from askmill.operators.inverted import retrieve_inverted
from askmill.operators.retrieve import nearest, retrieve, stuff_context
from askmill.operators.routes import route_questions
from askmill.operators.tools import FAILED, weather_tool
from askmill.operators.vectors import build_index, embed
from askmill.plans.answers import answer_questions
from askmill.plans.judging import judge_answers
from askmill.session import materialise, scratch_path
from askmill.sources.configs import answer_settings, parse_configs, question_rows
from askmill.sources.tables import TableSet, append_table, check_targets, drop_table, overwrite_table
from askmill.streaming.index_sync import chunk_changes, publish_changes, read_index, sync_index

EMBEDDER = HashingEmbedder(256)
MODELS = ("m0", "m1", "m2")
RAG_TEMPLATE = "Notes: {context}\n{{end of notes}}\nAsked: {question}\nReply:"
RUBRICS = {
    f"q{i}": rubric_template(f"reviewer number {i}", [f"level {k} of {i}" for k in range(1, 6)], f"aspect {i}")
    for i in range(1, 7)
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share when a small input has fewer partitions than there are cores.

    A large input has more partitions than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(documents(spark, sf_dir))


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(F.col("role") == "user")


def q_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir)


def q_chunk_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_lang = chunk_lengths(documents(spark, sf_dir), keep=["lang"]).groupBy("lang")
    return by_lang.agg(
        F.count("*").alias("n_chunks"),
        F.sum("n_words").alias("n_words"),
        F.round(F.avg("n_words"), 6).alias("avg_words"),
    )


def q_word_hash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = documents(spark, sf_dir).select(F.explode(words(F.col("text"))).alias("word"))
    return each.groupBy(word_bucket(F.col("word")).alias("bucket")).agg(F.count("*").alias("n_words"))


def q_hash_embed_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embed(chunks(spark, sf_dir), "text", EMBEDDER)
    return vectors.select(
        "id",
        F.round(F.col("norm") * F.col("norm")).cast("bigint").alias("sq_norm"),
        F.size(F.array_remove("embedding", F.lit(0.0).cast("float"))).alias("n_buckets"),
    )


def q_knn_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("norm", vector_norm(F.col("embedding")))
    # No repartition first: the work items deal the index over one block per core at least.
    index = vectors.select(F.col("vec_id").alias("id"), "embedding", "norm")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding", "norm")
    return nearest(queries, index, k=4).withColumn("sim", F.round("sim", 6))


def q_knn_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``knn_top4`` with index blocks clustered by direction and skipped by angle bounds."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("norm", vector_norm(F.col("embedding")))
    index = vectors.select(F.col("vec_id").alias("id"), "embedding", "norm")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding", "norm")
    hits, _, _ = nearest_clustered(queries, index, k=4, clusters=64)
    return hits.withColumn("sim", F.round("sim", 6))


def _benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieve(questions, build_index(chunks(spark, sf_dir), EMBEDDER), EMBEDDER)


def q_retrieve_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark_hits(spark, sf_dir).withColumn("sim", F.round("sim", 6))


def q_retrieve_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = retrieve_inverted(questions, build_index(chunks(spark, sf_dir), EMBEDDER), EMBEDDER)
    return hits.withColumn("sim", F.round("sim", 6))


def q_rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuff_context(_benchmark_hits(spark, sf_dir))


def q_rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = user_turns(spark, sf_dir).select(
        F.concat("conv_id", F.lit("-"), "turn").alias("query_id"), F.col("text").alias("question")
    )
    index = build_index(chunks(spark, sf_dir), EMBEDDER)
    contexts = stuff_context(retrieve(asked, index, EMBEDDER, text="question"))
    prompt = render(RAG_TEMPLATE, {"context": F.col("context"), "question": F.col("question")})
    return asked.join(contexts, "query_id").select("query_id", prompt.alias("prompt"))


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it; (conv_id, turn) is a unique key."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input_prompt"))
    given = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ai_output")
    )
    return asked.join(given, ["conv_id", "turn"])


def q_qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_pairs(spark, sf_dir).withColumn("model", F.lit("m0"))


def q_chat_messages_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = chat.messages_json(chat.messages(F.lit("Be brief."), F.col("text")))
    return user_turns(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.get_json_object(request, "$.messages[0].role").alias("first_role"),
        F.get_json_object(request, "$.messages[1].role").alias("second_role"),
        chat.user_content(request).alias("user_text"),
    )


# What each event type stands for in the answer log.
EVENT_QUESTIONS = {"view": "q1", "click": "q6", "purchase": "q_rag", "signup": "q_function", "error": "q0"}


def _event_question(event_type: Column) -> Column:
    chain = F
    for name, question in EVENT_QUESTIONS.items():
        chain = chain.when(event_type == name, question)
    return chain


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` in the shape of the results table; some scores are unreadable."""
    score = (
        F.when(F.col("event_id") % 11 == 0, "None")
        .when(F.col("event_id") % 13 == 0, "nan")
        .otherwise((F.col("event_id") % 5 + 1).cast("string"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        _event_question(F.col("event_type")).alias("question"),
        F.concat(F.lit("About "), F.col("event_type"), F.lit("?")).alias("input_prompt"),
        F.concat(F.lit("m"), F.col("user_id") % len(MODELS)).alias("model"),
        F.col("value").alias("time_s"),
        score.alias("score"),
        F.col("ts").alias("inserted"),
    )


def q_route_answer_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    default = F.struct(F.lit(400).alias("max_tokens"), F.lit(0.7).alias("temperature"))
    routed = route_questions(event_log(spark, sf_dir).withColumn("extra_params", default))
    return routed.select("event_id", "question", "answer_type", "params.max_tokens", "params.temperature")


def q_config_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a config file whose questions are its lines."""
    lines = F.transform(
        F.split("text", "\n"), lambda line, at: F.struct(F.concat(F.lit("q"), at).alias("key"), line.alias("value"))
    )
    written = documents(spark, sf_dir).select(
        F.to_json(
            F.struct(
                F.struct(
                    F.concat(F.lit("model "), "doc_id").alias("model_name"),
                    F.struct(F.lit(400).alias("max_tokens"), F.lit(0.7).alias("temperature")).alias("extra_params"),
                ).alias("configs"),
                F.map_from_entries(lines).alias("questions"),
            )
        ).alias("json")
    )
    rows = question_rows(answer_settings(written.select(parse_configs(F.col("json")).alias("c")).select("c.*")))
    return rows.select("model", "pos", "question", "input_prompt", "extra_params.max_tokens")


def q_tool_call_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with no, one or two tool calls, written from ``props`` and read back."""
    call = F.struct(F.struct(F.lit("lookup").alias("name"), F.col("props").alias("arguments")).alias("function"))
    written = (
        F.when(F.col("event_type") == "error", F.to_json(F.array().cast(chat.schemas.TOOL_CALLS)))
        .when(F.col("event_type") == "view", F.to_json(F.array(call, call)))
        .otherwise(F.to_json(F.array(call)))
    )
    calls = chat.parse_tool_calls(F.col("written"))
    return (
        table(spark, sf_dir, "events")
        .select("event_id", written.alias("written"))
        .select("event_id", F.size(calls).alias("n_calls"), chat.tool_argument(calls, "k").alias("argument"))
    )


def q_tool_enrich_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the value of the user's latest view until then."""
    events = table(spark, sf_dir, "events")
    asks = events.select("event_id", "user_id", F.col("ts").alias("asked_at"))
    views = events.where(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("observed_at"), F.col("value").alias("seen")
    )
    found = latest_before(asks, views, "user_id", "asked_at", "observed_at", "seen")
    return found.select("event_id", "user_id", "seen")


def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered questions under keys q0 to q7; q0 is not judged, and q7 or no key has no rubric."""
    keyed = F.when((F.col("conv_id") % 8 < 7) | (F.col("turn") % 4 > 0), F.concat(F.lit("q"), F.col("conv_id") % 8))
    return qa_pairs(spark, sf_dir).withColumn("question", keyed)


def q_judge_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = to_judge(judged_pairs(spark, sf_dir))
    prompts, _ = rubric_prompts(answers, rubrics_table(spark, RUBRICS), mode="quarantine")
    return prompts.select("conv_id", "turn", "question", "judge_prompt")


def q_judge_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = to_judge(judged_pairs(spark, sf_dir))
    _, rejected = rubric_prompts(answers, rubrics_table(spark, RUBRICS), mode="quarantine")
    return rejected.select("conv_id", "turn", "question")


def _verdict_text() -> Column:
    """A judge's reply around an answer, in the forms a judge may or may not keep to."""
    score = (F.col("turn") % 5 + 1).cast("string")
    form = F.col("conv_id") % 4
    return (
        F.when(form == 0, F.concat(F.lit("**Score:** "), score, F.lit("\n**Explanation:** "), F.col("ai_output")))
        .when((form == 1) & (F.col("turn") % 3 == 0), F.concat(F.lit("**Score:**\u00a0"), F.translate(score, "12345", "١٢٣٤٥")))
        .when((form == 1) & (F.col("turn") % 3 == 1), F.concat(F.lit("**Explanation:**\u202f\x1f"), F.col("ai_output")))
        .when(form == 1, F.concat(F.lit("**Score:**"), score, F.lit("/5")))
        .when(form == 2, F.concat(F.lit("**Explanation:** "), F.col("ai_output"), F.lit("**Score:** none")))
        .otherwise(F.col("ai_output"))
    )


def q_judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = with_verdict(qa_pairs(spark, sf_dir).withColumn("reply", _verdict_text()), "reply")
    return read.select("conv_id", "turn", "score", "explanation", "score_num")


def q_judge_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers; every benchmark item is the truth of some, as its own answer type."""

    def keys(number: Column) -> list[Column]:
        return [F.concat(F.lit("m"), number % 4).alias("model"), F.concat(F.lit("item"), number).alias("answer_type")]

    items = table(spark, sf_dir, "benchmark")
    n_items = items.select(F.max("item_id")).first()[0] + 1
    answers = documents(spark, sf_dir).select("doc_id", *keys(F.col("doc_id") % n_items), F.col("text").alias("ai_output"))
    truths = items.select(*keys(F.col("item_id")), F.col("text").alias("truth"))
    verdicts, _ = judge_by_similarity(answers, truths)
    return verdicts.select("doc_id", "score", "explanation")


def q_unjudged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label; the language, which some lack, is part of the key."""
    known_lang = F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang")
    answers = table(spark, sf_dir, "documents").select("doc_id", known_lang)
    judged = answers.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return not_yet_judged(answers, judged, ["doc_id", "lang"])


def q_results_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even conversations judged by rubric, odd ones by similarity to the question."""
    pairs = qa_pairs(spark, sf_dir).withColumn(
        "answer_type", F.when(F.col("conv_id") % 2 == 0, "normal").otherwise("rag")
    )
    columns = ["conv_id", "turn", "answer_type", "score", "explanation"]
    normal = with_verdict(pairs.where(F.col("answer_type") == "normal").withColumn("reply", _verdict_text()), "reply")
    other, _ = judge_by_similarity(
        pairs.where(F.col("answer_type") != "normal").withColumn("truth", F.col("input_prompt"))
    )
    return normal.select(*columns).unionByName(other.select(*columns))


def q_relabel_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"q_rag": "RAG", "q_function": "FUNCTION"}
    return relabelled(event_log(spark, sf_dir), names).select("event_id", "question")


def uneven_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with rows that lack their question and scores without end."""
    return event_log(spark, sf_dir).withColumns(
        {
            "question": F.when(F.col("event_id") % 17 > 0, F.col("question")),
            "score": F.when(F.col("event_id") % 19 == 0, F.lit("inf")).otherwise(F.col("score")),
        }
    )


def q_summary_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return averages(uneven_log(spark, sf_dir))


def q_summary_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return averages(uneven_log(spark, sf_dir), exclude=(), truncate=True)


def q_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_rows(event_log(spark, sf_dir))


def q_report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison(event_log(spark, sf_dir), MODELS)


def q_latest_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = latest_per_key(event_log(spark, sf_dir), ["model", "question"], [F.col("inserted").desc(), F.col("event_id").desc()])
    return newest.select("model", "question", "event_id", "time_s")


def q_model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of one model over its newest answers, with the place of each row."""
    newest = latest_per_key(event_log(spark, sf_dir), ["model", "question"], [F.col("inserted").desc(), F.col("event_id").desc()])
    report = model_report(newest, "m0", placeholders=("m1",))
    # A row a question and two totals: the place in the sorted report.
    order = Window.orderBy(F.monotonically_increasing_id())
    return report.withColumn("position", F.row_number().over(order))


def q_stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in a table: checked for, appended to twice and read; a second table is written, replaced and dropped."""
    names = TableSet("spark_catalog", "default", f"run_{uuid.uuid4().hex}")
    check_targets(spark, names)
    log = event_log(spark, sf_dir)
    for rest in (0, 1):
        append_table(log.where(F.col("event_id") % 2 == rest), names.answers, partition_by=("model",))
    overwrite_table(log.select("event_id"), names.chunks)
    overwrite_table(spark.read.table(names.answers).groupBy("model").count(), names.results)
    counted = spark.read.table(names.results).withColumnRenamed("count", "n_of_model")
    drop_table(spark, names.chunks)
    if spark.catalog.tableExists(names.chunks):
        raise RuntimeError("a dropped table is still there")
    return spark.read.table(names.answers).join(counted, "model").select("event_id", "model", "question", "score", "n_of_model")


def q_index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of small chunks, brought in step with large ones by a second sync.

    A third one confirms every third chunk and deletes ids that never were; the
    older deletions and insertions that come after it must change nothing.
    """
    feed, index, checkpoint = (scratch_path(spark, name) for name in ("feed", "index", "sync"))
    docs = documents(spark, sf_dir)
    first, second = chunk_documents(docs, size=100, overlap=0), chunk_documents(docs)
    empty = first.limit(0)
    publish_changes(chunk_changes(empty, first, 1), feed)
    sync_index(spark, feed, index, checkpoint, EMBEDDER)
    publish_changes(chunk_changes(first, second, 2), feed)
    sync_index(spark, feed, index, checkpoint, EMBEDDER)
    third = second.where(F.col("chunk_ix") % 3 == 0).select("id", "text")
    unknown = third.withColumn("id", F.concat(F.lit("gone "), "id"))
    for confirmed, other, seq in (("upsert", "delete", 7), ("delete", "upsert", 6)):
        late = third.withColumn("op", F.lit(confirmed)).unionByName(unknown.withColumn("op", F.lit(other)))
        publish_changes(late.withColumn("seq", F.lit(seq).cast("bigint")), feed)
        sync_index(spark, feed, index, checkpoint, EMBEDDER)
    return read_index(spark, index).select(
        "id", "content_hash", F.round(F.col("norm") * F.col("norm")).cast("bigint").alias("sq_norm")
    )


def q_generate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn through the stub, which fails on texts that hold 'zu'."""
    requests = user_turns(spark, sf_dir).select(
        "conv_id", "turn", chat.messages_json(chat.messages(F.lit("Be brief."), F.col("text"))).alias("request")
    )
    replies = generate(requests, lambda: EchoStub(fail_on="zu"))
    answer = F.when(F.col("error").isNotNull(), F.lit(FAILED)).otherwise(F.col("ai_output"))
    return replies.select("conv_id", "turn", answer.alias("ai_output"), "error")


def flow_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions of three models, along all three routes."""
    key = F.element_at(
        F.array(*[F.lit(q) for q in ("q0", "q1", "q2", "q3", "q4", "q5", "q6", "q_rag", "q_function")]),
        (F.col("conv_id") % 9 + 1).cast("int"),
    )
    weather = F.concat(F.lit("Weather in City"), F.col("turn") % 7, F.lit(" now?"))
    turns = user_turns(spark, sf_dir).withColumn("question", key)
    return turns.select(
        F.concat(F.lit("m"), F.col("conv_id") % len(MODELS)).alias("model"),
        F.lit("local").alias("endpoint"),
        "question",
        F.when(F.col("question") == "q_function", weather).otherwise(F.col("text")).alias("input_prompt"),
        F.lit("Be brief.").alias("system_prompt"),
        F.lit(RAG_TEMPLATE).alias("rag_prompt"),
        F.struct(F.lit(400).alias("max_tokens"), F.lit(0.7).alias("temperature")).alias("extra_params"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as weather reports of five cities."""
    report = F.struct(
        F.array(
            F.struct(
                F.col("value").cast("string").alias("temp_C"),
                F.array(F.struct(F.col("event_type").alias("value"))).alias("weatherDesc"),
            )
        ).alias("current_condition")
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("City"), F.col("user_id") % 5).alias("city"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.to_json(report).alias("payload_json"),
    )


def _flow_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_questions(
        flow_questions(spark, sf_dir),
        build_index(chunks(spark, sf_dir), EMBEDDER),
        lambda: EchoStub(fail_on="zu"),
        [weather_tool(observations(spark, sf_dir))],
        EMBEDDER,
    )


def q_answer_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow_answers(spark, sf_dir).select(
        "model", "question", "answer_type", "input_prompt", "ai_output", "failed", "error"
    )


def q_judge_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all routes judged; a third of the benchmark items is the truth of each model's rag answers."""
    answers = materialise(_flow_answers(spark, sf_dir), "answers")
    params = F.struct(F.lit(250).alias("max_tokens"), F.lit(0.1).alias("temperature"))
    items = F.array_sort(F.collect_list(F.struct("item_id", "text")))
    truths = (
        table(spark, sf_dir, "benchmark")
        .groupBy(F.concat(F.lit("m"), F.col("item_id") % len(MODELS)).alias("model"))
        .agg(F.array_join(F.transform(items, lambda item: item["text"]), " ").alias("rag_ground_truth"))
    )
    settings = truths.select(
        "model",
        F.lit("local").alias("judge_endpoint"),
        params.alias("judge_params"),
        F.lit("Judge.").alias("judge_system_prompt"),
        "rag_ground_truth",
    )
    verdicts, _ = judge_answers(
        answers, settings, rubrics_table(spark, RUBRICS), observations(spark, sf_dir), LengthJudgeStub, "City0"
    )
    return materialise(verdicts, "verdicts").select(
        "model", "question", "answer_type", "input_prompt", "ai_output", "score", "explanation"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "chunk_documents": q_chunk_documents,
    "chunk_stats_by_lang": q_chunk_stats_by_lang,
    "word_hash_buckets": q_word_hash_buckets,
    "hash_embed_norm": q_hash_embed_norm,
    "knn_top4": q_knn_top4,
    "knn_clustered": q_knn_clustered,
    "retrieve_chunks": q_retrieve_chunks,
    "retrieve_inverted": q_retrieve_inverted,
    "rag_context": q_rag_context,
    "rag_prompt": q_rag_prompt,
    "qa_pairs": q_qa_pairs,
    "chat_messages_json": q_chat_messages_json,
    "route_answer_type": q_route_answer_type,
    "config_questions": q_config_questions,
    "tool_call_parse": q_tool_call_parse,
    "tool_enrich_asof": q_tool_enrich_asof,
    "judge_prompt": q_judge_prompt,
    "judge_rejects": q_judge_rejects,
    "judge_parse": q_judge_parse,
    "judge_similarity": q_judge_similarity,
    "unjudged_answers": q_unjudged_answers,
    "results_union": q_results_union,
    "relabel_sorted": q_relabel_sorted,
    "summary_by_model": q_summary_by_model,
    "summary_truncated": q_summary_truncated,
    "report_rows": q_report_rows,
    "report_pivot": q_report_pivot,
    "latest_answer": q_latest_answer,
    "model_report": q_model_report,
    "stored_log": q_stored_log,
    "index_sync": q_index_sync,
    "generate_stub": q_generate_stub,
    "answer_flow": q_answer_flow,
    "judge_flow": q_judge_flow,
}
