"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from askmill.llm.licenses import RULES, SENTENCES, normal

#: Documents with their words; a null text has none.
_WORDS = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents)"""

_COMPONENTS = """
linked AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, least) AS (
  SELECT {node}, {node} FROM {nodes}
  UNION
  SELECT l.b, r.least FROM reach r JOIN linked l ON l.a = r.node),
component AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node)"""



def _licence_sql() -> str:
    known = "MAP {" + ", ".join(f"'{normal(s)}': '{name}'" for name, s in SENTENCES.items()) + "}"
    whens = " ".join(f"WHEN contains(ids, ',{','.join(ids)},') THEN '{name}'" for name, ids in RULES)

    def read(text: str) -> str:
        lowered = "translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        key = f"trim(regexp_replace({lowered}, '[^a-z0-9.]+', ' ', 'g'), ' .')"
        cut = f"string_split(regexp_replace({text}, '([.!?;:])[ \\t\\r]+', '\\1\n', 'g'), chr(10))"
        return f"list_filter(list_transform({cut}, lambda s: known[{key}]), lambda x: x IS NOT NULL)"

    marked = "regexp_replace(coalesce(text, ''), '\\n[ \\t\\r]*\\n', chr(1), 'g')"
    unwrapped = f"translate(regexp_replace({marked}, '[\\r\\n]+', ' ', 'g'), chr(1), chr(10))"
    return f"""
WITH k AS (SELECT {known} AS known),
r AS (
  SELECT doc_id, {read("coalesce(text, '')")} AS lines,
         {read(unwrapped)} AS wrapped
  FROM documents, k),
c AS (SELECT doc_id, CASE WHEN len(wrapped) > len(lines) THEN wrapped ELSE lines END AS found FROM r),
i AS (SELECT doc_id, array_to_string(found, ',') AS sentence_ids, len(found)::BIGINT AS n_known FROM c)
SELECT doc_id, sentence_ids, n_known, CASE {whens} END AS licence
FROM (SELECT *, ',' || sentence_ids || ',' AS ids FROM i)
"""


ORACLE: dict[str, str] = {
    "op5_minhash": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN []
         WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
{_COMPONENTS.format(node="doc_id", nodes="documents")}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN component c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op10_host_quality": rf"""
{_WORDS},
p AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM p),
g AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM r WHERE c > 1),
t AS (SELECT doc_id, sum(least(8, coalesce(following - i, 8))) AS n FROM g GROUP BY doc_id),
b AS (
  SELECT d.doc_id, d.source,
         len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(t.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d) d
  LEFT JOIN t ON t.doc_id = d.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
q AS (
  SELECT sum(k) / sum(n) AS mean, sum(n) AS total, count(*) AS hosts, sum(n * (k / n) * (k / n)) AS squares, sum(n * n) AS n2
  FROM h),
v AS (
  SELECT mean, total / hosts * 1000 AS most,
         CASE WHEN total - n2 / total > 0
              THEN greatest((squares - total * mean * mean - (hosts - 1) * mean * (1 - mean)) / (total - n2 / total), 0)
              ELSE 0 END AS variance
  FROM q),
u AS (
  SELECT mean, CASE WHEN variance > 0 THEN least(greatest(mean * (1 - mean) / variance - 1, 0), most) ELSE most END AS weight
  FROM v)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce((h.k + u.mean * u.weight) / (h.n + u.weight) <= 0.5, true) AS kept
FROM f CROSS JOIN u LEFT JOIN h ON h.source = f.source
""",
    "op6_collision_counting": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.e) = len(q.e)
  WHERE list_cosine_similarity(p.e, q.e) >= 0.93),
{_COMPONENTS.format(node="vec_id", nodes="embeddings")},
n AS (SELECT a AS vec_id, count(*) AS n FROM (SELECT a FROM links UNION ALL SELECT b FROM links) GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN component c ON c.node = v.vec_id LEFT JOIN n ON n.vec_id = v.vec_id
""",
    "op7_licence_sentences": _licence_sql(),
}
