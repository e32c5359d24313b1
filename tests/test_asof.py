import datetime as dt
import random

import pytest

from askmill.operators.asof import _hot_keys, latest_before

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + dt.timedelta(minutes=minutes)


def run(spark, asks, seen, fits):
    asked = spark.createDataFrame([(i, k, at(t)) for i, (k, t) in enumerate(asks)], "i int, city string, asked_at timestamp")
    held = spark.createDataFrame([(k, at(t), v) for k, t, v in seen], "city string, observed_at timestamp, value string")
    found = latest_before(asked, held, "city", "asked_at", "observed_at", "value", fits)
    assert found.columns == ["i", "city", "asked_at", "value"]
    return {r.i: r.value for r in found.collect()}


def expected(asks, seen):
    out = {}
    for i, (key, t) in enumerate(asks):
        known = [(s, v is not None, v or "") for k, s, v in seen if k == key and None not in (key, t, s) and s <= t]
        best = max(known, default=None)
        out[i] = best[2] if best and best[1] else None
    return out


@pytest.mark.parametrize("fits", [0, 20, 400, 10**6])
def test_against_a_loop_with_one_hot_key(spark, fits):
    rng = random.Random(fits)
    seen = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(300), f"v{i:03d}") for i in range(200)]
    asks = [(rng.choice(["hot"] * 8 + ["a", "b", "unseen", None]), rng.randrange(300)) for _ in range(300)]
    asks += [("hot", 150)] * 200 + [("hot", None)]
    assert run(spark, asks, seen, fits) == expected(asks, seen)


def test_a_key_over_the_size_of_a_task_is_hot_whatever_its_share(spark):
    rows = [("k",)] * 150 + [(f"o{i}",) for i in range(20_000)]
    assert _hot_keys(spark.createDataFrame(rows, "city string"), "city", 100).collect() == [("k",)]


def test_all_asks_at_one_time(spark):
    seen = [("a", t, f"v{t}") for t in range(60)]
    asks = [("a", 30)] * 500
    assert run(spark, asks, seen, 50) == {i: "v30" for i in range(500)}


@pytest.mark.parametrize("seed", [1, 2])
def test_asks_at_few_moments_sort_no_observations(spark, monkeypatch, seed):
    from askmill.operators import asof

    def refused(*_):
        raise AssertionError("the observations of a key are brought together")

    monkeypatch.setattr(asof, "_hot_keys", refused)
    monkeypatch.setattr(asof, "_in_one_window", refused)
    rng = random.Random(seed)
    seen = [(rng.choice(["a", "b", None]), rng.choice([*range(40), None]), rng.choice([f"v{i:03d}", None])) for i in range(300)]
    asks = [(rng.choice(["a", "b", "unseen", None]), rng.choice([0, 7, 20, 39, 90, None])) for _ in range(200)]
    assert run(spark, asks, seen, 1_000_000) == expected(asks, seen)


def test_null_values_count_as_observed(spark):
    seen = [("a", 1, "old"), ("a", 2, None)]
    assert run(spark, [("a", 1), ("a", 3)], seen, 0) == {0: "old", 1: None}


def test_before_first_and_no_observations(spark):
    assert run(spark, [("a", 1)], [("a", 2, "x")], 0) == {0: None}
    assert run(spark, [("a", 1)], [], 9) == {0: None}


def test_no_pairs_are_joined(spark):
    asked = spark.createDataFrame([], "city string, asked_at timestamp")
    held = spark.createDataFrame([], "city string, observed_at timestamp, value string")
    plan = latest_before(asked, held, "city", "asked_at", "observed_at", "value")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
