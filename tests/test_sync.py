import os

from pyspark.sql import functions as F

from askmill.operators.vectors import build_index
from askmill.streaming.index_sync import (
    VERSIONS,
    _news,
    apply_changes,
    chunk_changes,
    compact_index,
    drop_index,
    publish_changes,
    read_index,
    sync_index,
)


def chunks(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "id string, text string")


def state(spark, index):
    return {r.id: r.text for r in read_index(spark, index).collect()}


def versions(index):
    return sorted(d for d in os.listdir(index) if d.startswith("version="))


def test_index_follows_the_chunks(spark, tmp_path):
    feed, index, checkpoint = (str(tmp_path / n) for n in ("feed", "index", "checkpoint"))
    one = chunks(spark, a="x", b="y", c="z")
    publish_changes(chunk_changes(one.limit(0), one, 1), feed)
    sync_index(spark, feed, index, checkpoint)
    assert state(spark, index) == {"a": "x", "b": "y", "c": "z"}

    two = chunks(spark, a="x", b="changed", d="new")
    changes = chunk_changes(one, two, 2)
    assert sorted((r.id, r.op) for r in changes.collect()) == [("b", "upsert"), ("c", "delete"), ("d", "upsert")]
    publish_changes(changes, feed)
    sync_index(spark, feed, index, checkpoint)
    assert state(spark, index) == {"a": "x", "b": "changed", "d": "new"}

    before = versions(index)
    sync_index(spark, feed, index, checkpoint)
    assert versions(index) == before

    # Back to an earlier text: only the newest state counts as known.
    publish_changes(chunk_changes(two, one, 3), feed)
    sync_index(spark, feed, index, checkpoint)
    key = lambda row: row["id"]
    assert sorted(read_index(spark, index).collect(), key=key) == sorted(
        build_index(one).select(*read_index(spark, index).columns).collect(), key=key
    )

    drop_index(spark, index, checkpoint)
    assert not os.path.exists(index) and read_index(spark, index).count() == 0


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    index = str(tmp_path / "index")
    first = chunk_changes(chunks(spark, z="z").limit(0), chunks(spark, a="1", b="2"), 1)
    apply_changes(first, 0, index)
    second = chunk_changes(chunks(spark, a="1", b="2"), chunks(spark, a="1", b="3"), 2)
    for _ in range(3):
        apply_changes(second, 1, index)
    assert spark.read.parquet(index).count() == 3
    assert state(spark, index) == {"a": "1", "b": "3"}


def test_compacted_index_goes_on(spark, tmp_path):
    index, target = str(tmp_path / "index"), str(tmp_path / "target")
    states = [chunks(spark, a="1", b="2", c="3"), chunks(spark, a="1", b="4"), chunks(spark, a="5", b="4", d="6")]
    before = states[0].limit(0)
    for version, after in enumerate(states):
        apply_changes(chunk_changes(before, after, version), version, index)
        before = after
    compact_index(spark, index, target)
    assert versions(target) == ["version=-1"]
    assert state(spark, target) == state(spark, index) == {"a": "5", "b": "4", "d": "6"}
    # The last batch again changes nothing, the next one does.
    apply_changes(chunk_changes(states[1], states[2], 2), 2, target)
    assert state(spark, target) == {"a": "5", "b": "4", "d": "6"}
    apply_changes(chunk_changes(states[2], states[0], 3), 3, target)
    assert state(spark, target) == {"a": "1", "b": "2", "c": "3"}


def test_first_version_is_read_without_a_shuffle(spark, tmp_path):
    index = str(tmp_path / "index")
    apply_changes(chunk_changes(chunks(spark, z="z").limit(0), chunks(spark, a="1", b="2"), 1), 0, index)
    assert "Exchange" not in read_index(spark, index)._jdf.queryExecution().executedPlan().toString()
    apply_changes(chunk_changes(chunks(spark, a="1", b="2"), chunks(spark, a="1", b="3"), 2), 1, index)
    plan = read_index(spark, index)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "PartitionFilters: [isnotnull(version" in plan


def test_last_change_in_a_batch_wins_and_late_ones_lose(spark, tmp_path):
    index = str(tmp_path / "index")
    rows = [("a", "old", "upsert", 1), ("a", "new", "upsert", 5), ("b", None, "delete", 2), ("c", "t", "upsert", 3)]
    apply_changes(spark.createDataFrame(rows, "id string, text string, op string, seq bigint"), 0, index)
    assert state(spark, index) == {"a": "new", "c": "t"}
    late = [("a", "late", "upsert", 4), ("c", None, "delete", 9)]
    apply_changes(spark.createDataFrame(late, "id string, text string, op string, seq bigint"), 1, index)
    assert state(spark, index) == {"a": "new"}
    back = [("c", "t", "upsert", 10)]
    apply_changes(spark.createDataFrame(back, "id string, text string, op string, seq bigint"), 2, index)
    assert state(spark, index) == {"a": "new", "c": "t"}


def test_unchanged_text_is_not_written_again(spark, tmp_path):
    index = str(tmp_path / "index")
    rows = [("a", "same", "upsert", 1)]
    apply_changes(spark.createDataFrame(rows, "id string, text string, op string, seq bigint"), 0, index)
    rows = [("a", "same", "upsert", 2), ("b", "more", "upsert", 3)]
    apply_changes(spark.createDataFrame(rows, "id string, text string, op string, seq bigint"), 1, index)
    written = spark.read.parquet(index).where(F.col("version") == 1).orderBy("id")
    assert written.select("id", "op", "text", "embedding", "seq").collect()[0] == ("a", "touch", None, None, 2)
    assert written.select("id", "op").collect()[1:] == [("b", "upsert")]
    assert state(spark, index) == {"a": "same", "b": "more"}


def test_late_changes_lose_to_changes_that_altered_nothing(spark, tmp_path):
    index, compact = str(tmp_path / "index"), str(tmp_path / "compact")
    steps = [("a", "t", "upsert", 1)], [("a", "t", "upsert", 7), ("x", None, "delete", 5)]
    late = [("a", None, "delete", 4), ("x", "back", "upsert", 4)]
    for version, rows in enumerate([*steps, late]):
        apply_changes(spark.createDataFrame(rows, "id string, text string, op string, seq bigint"), version, index)
    assert state(spark, index) == {"a": "t"}
    compact_index(spark, index, compact)
    apply_changes(spark.createDataFrame(late, "id string, text string, op string, seq bigint"), 3, compact)
    assert state(spark, compact) == {"a": "t"}


def test_changes_at_one_place_in_the_feed_have_an_order(spark, tmp_path):
    rows = [("a", t, "upsert", 1) for t in ("one", "two", "three")]
    found = set()
    for i, order in enumerate((rows, rows[::-1])):
        index = str(tmp_path / f"index{i}")
        apply_changes(spark.createDataFrame(order, "id string, text string, op string, seq bigint"), 0, index)
        found.add(state(spark, index)["a"])
    assert len(found) == 1


def _shuffles(df):
    """The shuffles of a plan."""
    return [line for line in df._jdf.queryExecution().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_texts_of_single_changes_are_not_shuffled(spark, tmp_path):
    changes = spark.createDataFrame(
        [(f"id{i}", f"text {i}", "upsert", 5) for i in range(50)] + [("gone", None, "delete", 5), (None, "no id", "upsert", 5)],
        "id string, text string, op string, seq bigint",
    )
    empty = spark.createDataFrame([], VERSIONS)
    news = _news(changes, empty)
    assert not _shuffles(news)
    assert sorted((r.id or "", r.text, r.op) for r in news.collect()) == sorted((r.id or "", r.text, r.op) for r in changes.collect())


def test_single_repeated_late_and_touched_changes_of_one_batch(spark, tmp_path):
    index = str(tmp_path / "index")
    schema = "id string, text string, op string, seq bigint"
    apply_changes(spark.createDataFrame([(i, "x", "upsert", 5) for i in ("late", "touched", "changed")], schema), 0, index)
    rows = [
        ("late", "y", "upsert", 4),
        ("touched", "x", "upsert", 6),
        ("changed", "y", "upsert", 6),
        ("single", "s", "upsert", 6),
        ("repeated", "a", "upsert", 6),
        ("repeated", "b", "upsert", 7),
        ("repeated", "b", "upsert", 7),
        (None, "n", "upsert", 6),
        (None, "m", "upsert", 7),
        (None, "m", "upsert", 7),
    ]
    batch = spark.createDataFrame(rows, schema)
    apply_changes(batch, 1, index)
    written = spark.read.parquet(f"{index}/version=1").collect()
    assert sorted((r.id or "", r.text or "", r.op, r.seq) for r in written) == [
        ("", "m", "upsert", 7),
        ("changed", "y", "upsert", 6),
        ("repeated", "b", "upsert", 7),
        ("single", "s", "upsert", 6),
        ("touched", "", "touch", 6),
    ]
    assert all((r.embedding is None) == (r.text is None) and r.content_hash for r in written)
