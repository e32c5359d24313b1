import numpy as np

from askmill.operators.clustered import nearest_clustered
from askmill.operators.retrieve import nearest
from test_inverted import listed, vectors


def test_skips_blocks_and_equals_the_full_search(spark):
    rng = np.random.default_rng(3)
    # Four directions, tight around each: most blocks are far from a question.
    axes = np.eye(4) * 10
    index = [(f"c{i:03d}", (axes[i % 4] + rng.integers(0, 2, 4)).tolist()) for i in range(200)]
    index += [("z0", [0, 0, 0, 0]), ("n0", None), ("c000b", index[0][1])]
    queries = [(f"q{i}", (axes[i % 4] + rng.integers(0, 3, 4)).tolist()) for i in range(12)] + [("qz", [0, 0, 0, 0])]
    ask, idx = vectors(spark, queries, "query_id"), vectors(spark, index, "id")
    hits, kept, total = nearest_clustered(ask, idx, k=5, clusters=8, budget=64)
    assert listed(hits) == listed(nearest(ask, idx, 5, None, 64))
    assert kept < total


def test_few_rows(spark):
    ask = vectors(spark, [("q", [1, 0])], "query_id")
    idx = vectors(spark, [("a", [1, 0]), ("b", [0, 0])], "id")
    hits, _, _ = nearest_clustered(ask, idx, k=3, clusters=4)
    assert listed(hits) == [("q", 1, "a", 1.0), ("q", 2, "b", None)]
