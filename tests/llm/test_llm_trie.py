"""The conversation trie against a brute force over whole prefixes."""

import hashlib
import zlib

import pytest

from askmill.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows, group=5, kept=9):
    """Each conversation's rebuilt turns, by the rule of the operator, in plain Python."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    ordered = {
        c: [(r, t) for _, r, t in sorted(ts, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))] for c, ts in own.items()
    }
    out = {}
    for c, turns in ordered.items():
        h = zlib.crc32(str(c).encode()) % kept
        base = ordered.get(c - int(c - group * int(c / group)), [])  # c % group with the sign of c
        out[c] = base[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for key, members in nodes.items():
        d = len(key)
        children = [k for k in nodes if len(k) == d + 1 and k[:d] == key]
        subtree = [k for k in nodes if len(k) >= d and k[:d] == key]
        leaves = [k for k in subtree if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in nodes)]
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in subtree if k)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == d))
        parent = min(nodes[key[:-1]]) if d else None
        out[(min(members), d)] = (parent, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def run(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    got = prefix_trie.trie(df).collect()
    return {
        (r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got
    }, len(got)


CASES = [
    # shared first turns, ties in turn, repeated rows, null role, text and turn
    [(0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (1, 0, "user", "hi"), (1, 1, "assistant", "bye"),
     (2, 0, "user", "hi"), (2, 0, "user", "hi"), (3, None, None, None), (3, 1, "user", "x"), (4, 2, "user", "é"),
     (4, 2, "assistant", "é"), (5, 0, "user", "hi"), (6, 0, "user", "hi"), (6, 1, "assistant", "hello"),
     (7, 3, "user", "a" * 5000), (10, 0, "user", "hi"), (11, 0, "user", "hi"), (12, 7, "tool", ""),
     (None, 0, "user", "lost"), (-3, 0, "user", "hi"), (-3, 1, "user", "neg")],
    # one long conversation and copies of it
    [(c, t, "user" if t % 2 else "assistant", f"turn {t % 7}") for c in (20, 21, 22, 25, 26) for t in range(37)],
]


@pytest.mark.parametrize("rows", CASES)
def test_trie_equals_brute_force(spark, rows):
    got, n = run(spark, rows)
    want = brute(rows)
    assert n == len(got)
    assert got == want


def test_empty_and_turnless(spark):
    assert run(spark, [])[0] == {}
    got, _ = run(spark, [(5, None, None, None)])
    assert got == brute([(5, None, None, None)])


def test_clashing_columns(spark):
    rows = [(0, 0, "user", "hi", "x", 1), (1, 0, "user", "hi", "y", 2), (2, 1, "user", None, None, 3)]
    schema = SCHEMA + ", name string, depth bigint"
    got, _ = run(spark, rows, schema)
    assert got == brute([r[:4] for r in rows])
