import numpy as np
import pytest
from pyspark.sql import functions as F

from askmill.operators import inverted
from askmill.operators.inverted import nearest_inverted
from askmill.operators.retrieve import nearest


def vectors(spark, rows, key):
    df = spark.createDataFrame(
        [(k, None if v is None else [float(x) for x in v]) for k, v in rows], f"{key} string, embedding array<float>"
    )
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    return df.withColumn("norm", norm).repartition(3)


def listed(hits):
    return sorted((r.query_id, r.rank, r.id, None if r.sim is None else round(r.sim, 9)) for r in hits.collect())


def brute(queries, index, k):
    out = []
    for q, a in queries:
        if a is None:
            continue
        scored = []
        for c, b in index:
            if b is None:
                continue
            size = np.linalg.norm(a) * np.linalg.norm(b)
            sim = float(np.dot(a, b) / size) if size else None
            scored.append(((0, -round(sim, 9)) if sim is not None else (1, 0), c, sim))
        for rank, (_, c, sim) in enumerate(sorted(scored)[:k], 1):
            out.append((q, rank, c, None if sim is None else round(sim, 9)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("k", [1, 4, 9])
def test_equals_brute_force_and_dense(spark, seed, k, monkeypatch):
    rng = np.random.default_rng(seed)
    # sparse counts: many zeros, ties, repeated vectors, zero and missing vectors
    index = [(f"c{i:03d}", (rng.random(12) < 0.25) * rng.integers(1, 3, 12)) for i in range(60)]
    index += [("c900", np.zeros(12)), ("c901", None), ("c902", index[0][1]), ("c903", index[0][1])]
    queries = [(f"q{i}", (rng.random(12) < 0.3) * rng.integers(1, 4, 12)) for i in range(15)]
    queries += [("qz", np.zeros(12)), ("qn", None), ("qhot", np.eye(12)[0] * 3)]
    monkeypatch.setattr(inverted, "PART_ROWS", 4)  # every list is split into parts
    got = listed(nearest_inverted(vectors(spark, queries, "query_id"), vectors(spark, index, "id"), k))
    assert got == brute(queries, index, k)
    assert got == listed(nearest(vectors(spark, queries, "query_id"), vectors(spark, index, "id"), k))


def test_few_chunks_and_no_questions(spark):
    index = vectors(spark, [("a", [1, 0]), ("b", [0, 0])], "id")
    asked = vectors(spark, [("q", [0, 1])], "query_id")
    assert listed(nearest_inverted(asked, index, 5)) == [("q", 1, "a", 0.0), ("q", 2, "b", None)]
    assert nearest_inverted(asked.where("false"), index, 3).count() == 0


def test_lists_are_pruned(spark):
    # One strong shared bucket and many weak ones: the weak lists are not essential.
    index = [(f"c{i}", [5, 1, 0, 0] if i < 5 else [0, 1, 1, 1]) for i in range(40)]
    asked = vectors(spark, [("q", [4, 1, 0, 0])], "query_id")
    hits = nearest_inverted(asked, vectors(spark, index, "id"), 3)
    assert [r.id for r in hits.orderBy("rank").collect()] == ["c0", "c1", "c2"]


def test_no_posting_or_pair_is_a_row(spark):
    # 30 questions and 400 chunks that all share a bucket: 12,000 pairs, 4 x 400 postings.
    index = vectors(spark, [(f"c{i:03d}", [1 + i % 7, i % 5, i % 3, 1]) for i in range(400)], "id")
    asked = vectors(spark, [(f"q{i:02d}", [1, i % 4, i % 6, 2]) for i in range(30)], "query_id")
    hits = nearest_inverted(asked, index, 3, 4)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "(item#" in plan
    assert listed(hits) == listed(nearest(asked, index, 3, 4))
