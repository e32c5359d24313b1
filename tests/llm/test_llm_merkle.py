"""The Merkle manifest against a plain Python tree."""

import hashlib
import zlib

import pytest

from askmill.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    if value is None:
        return "-"
    value = str(value)
    return f"{len(value.encode())}:{value}"


def leaf(row, extra=0):
    doc_id, source, lang, n_chars, text = row
    n = None if n_chars is None else n_chars + extra
    return h("".join(field(v) for v in (doc_id, source, lang, n, text)))


def build(nodes):
    """Levels of runs over ``nodes``: the top, and for each node its (sibling, is_right) steps."""
    steps = [[] for _ in nodes]
    at = list(range(len(nodes)))  # which current node each original one is under
    now = list(nodes)
    while len(now) > 1:
        nxt = []
        for k in range(0, len(now), 2):
            run = now[k : k + 2]
            nxt.append(h("".join(run)))
        for i, pos in enumerate(at):
            run_start = pos - pos % 2
            run = now[run_start : run_start + 2]
            sib = run[1 - pos % 2] if len(run) == 2 else None
            steps[i].append((sib, pos % 2 == 1))
            at[i] = pos // 2
        now = nxt
    return now[0], steps


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    subroot, paths, order = {}, {}, {}
    for lang in langs:
        members = sorted([r for r in rows if r[2] == lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, steps = build([leaf(r) for r in members])
        subroot[lang] = top
        order[lang] = list(zip(members, steps))
    root, upper = build([subroot[lang] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for row, steps in order[lang]:
            path = steps + upper[k]
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            acc = leaf(row, 1 if tampered else 0)
            for sib, right in path:
                acc = h(acc if sib is None else (sib + acc if right else acc + sib))
            proof = h("".join(s for s, _ in path if s is not None))
            out.append((row[0], leaf(row), subroot[lang], root, proof, acc, acc == root))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def run(spark, rows, schema=SCHEMA):
    got = merkle.manifest(spark.createDataFrame(rows, schema)).collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


ROWS = [(i, "web" if i % 3 else None, ["en", "de", None, "fr", "é"][i % 5] if i < 40 else "en", i * 7 if i % 4 else None, f"text {i % 6}" if i % 9 else None) for i in range(70)]
ROWS += [(7, "web", "en", 49, "text 1"), (7, "web", "en", 49, "text 1"), (None, None, "de", 3, ""), (None, "x", None, None, "long " * 5000), (100, "s", "solo", 1, "one")]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[:2], ROWS[:3], [r for r in ROWS if r[2] == "en"]])
def test_manifest_equals_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_tampering_is_caught_only_where_it_changes_a_leaf(spark):
    got = run(spark, ROWS)
    for row, r in zip(sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))), got):
        changed = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
        assert r[6] == (not changed)


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    rows = [(1, "a", "en", 3, "x", "p", 9), (2, "b", "en", None, None, "q", 8)]
    got = run(spark, rows, SCHEMA + ", path string, idx bigint")
    assert got == brute([r[:5] for r in rows])
