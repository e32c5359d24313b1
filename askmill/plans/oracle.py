"""SQL that gives the same rows as the registered queries, for checking."""

from __future__ import annotations

from askmill.operators.judge import EXCLUDED
from askmill.plans.registered import EVENT_QUESTIONS, RAG_TEMPLATE, RUBRICS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _rendered(template: str, slots: dict[str, str]) -> str:
    """A template as a SQL concatenation."""
    parts = [template]
    for name in slots:
        slot = "{" + name + "}"
        parts = [p for part in parts for p in _around(part, slot)]
    literals = (p.replace("{{", "{").replace("}}", "}") for p in parts)
    return " || ".join(slots[p[1:-1]] if p[1:-1] in slots and p[0] == "{" else _text(q) for p, q in zip(parts, literals) if p)


def _around(part: str, slot: str) -> list[str]:
    out: list[str] = []
    for i, piece in enumerate(part.split(slot)):
        out += [slot, piece] if i else [piece]
    return out


def _words(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')"


def _echo(text: str) -> str:
    return f"array_to_string({_words(text)}, ' ') || ' (' || len({_words(text)}) || ' words, ' || md5({text}) || ')'"


_HASHED = "lambda w: ('0x' || substr(md5(w), 1, 8))::bigint % 256"


def _windows(name: str, size: int = 200, stride: int = 150) -> str:
    return f"""
{name} AS (
  SELECT doc_id || '_doc_' || (s // {stride} + 1) AS id, doc_id::varchar AS doc_id, lang,
         (s // {stride} + 1)::int AS chunk_ix, w[s + 1 : s + {size}] AS cw,
         array_to_string(w[s + 1 : s + {size}], ' ') AS text
  FROM (SELECT doc_id, lang, w, unnest(range(0, len(w), {stride})) AS s
        FROM (SELECT doc_id, lang, {_words('text')} AS w FROM documents)))"""


_CHUNKS = _windows("chunks")


def _counts(name: str, source: str, key: str, text: str) -> str:
    return f"""
{name} AS (
  SELECT {key} AS id, b, count(*) AS n
  FROM (SELECT {key}, unnest(list_transform({text}, {_HASHED})) AS b FROM {source})
  GROUP BY 1, 2),
{name}_norm AS (SELECT id, sqrt(sum(n * n)) AS norm FROM {name} GROUP BY id)"""


def _hits(source: str, key: str, text: str) -> str:
    """Top four chunks per question; pairs without a common bucket have similarity 0."""
    return f"""
WITH {_CHUNKS},
{_counts('ct', 'chunks', 'id', 'cw')},
{_counts('qt', source, key, _words(text))},
pairs AS (
  SELECT q.id AS query_id, c.id AS id, sum(q.n * c.n) AS dot
  FROM qt q JOIN ct c ON q.b = c.b GROUP BY 1, 2),
sims AS (
  SELECT query_id, p.id, dot / (a.norm * b.norm) AS sim
  FROM pairs p JOIN qt_norm a ON a.id = query_id JOIN ct_norm b ON b.id = p.id),
hits AS (
  SELECT query_id, rank, s.id, round(sim, 6) AS sim, text
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id)::int AS rank FROM sims) s
  JOIN chunks c ON c.id = s.id WHERE rank <= 4),
contexts AS (
  SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id)"""


_TURNS = """
(SELECT conv_id || '-' || turn AS query_id, text FROM conversations WHERE role = 'user')"""

_QA = """
qa AS (
  SELECT a.conv_id, a.turn, a.text AS input_prompt, b.text AS ai_output
  FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')"""

_QUESTION_OF_EVENT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_QUESTIONS.items()) + " END"

_LOG = f"""
log AS (
  SELECT event_id, {_QUESTION_OF_EVENT} AS question, 'About ' || event_type || '?' AS input_prompt,
         'm' || (user_id % 3) AS model, value AS time_s,
         CASE WHEN event_id % 11 = 0 THEN 'None' WHEN event_id % 13 = 0 THEN 'nan'
              ELSE (event_id % 5 + 1)::varchar END AS score,
         ts AS inserted
  FROM events)"""

_UNEVEN = _LOG.replace("log AS", "even AS", 1) + """,
log AS (
  SELECT * REPLACE (CASE WHEN event_id % 17 > 0 THEN question END AS question,
                    CASE WHEN event_id % 19 = 0 THEN 'inf' ELSE score END AS score) FROM even)"""

_NUMBER = "CASE WHEN score IN ('None', 'nan', 'inf') THEN NULL ELSE score::double END"

_REPLY = """CASE conv_id % 4
    WHEN 0 THEN '**Score:** ' || (turn % 5 + 1) || chr(10) || '**Explanation:** ' || ai_output
    WHEN 1 THEN CASE turn % 3
      WHEN 0 THEN '**Score:**' || chr(160) || translate((turn % 5 + 1)::varchar, '12345', '١٢٣٤٥')
      WHEN 1 THEN '**Explanation:**' || chr(8239) || chr(31) || ai_output
      ELSE '**Score:**' || (turn % 5 + 1) || '/5' END
    WHEN 2 THEN '**Explanation:** ' || ai_output || '**Score:** none'
    ELSE ai_output END"""

_BLANK = r"[\s\p{Z}\x1c-\x1f]*"
_SCORE = rf"""CASE WHEN regexp_matches(reply, '\*\*Score:\*\*{_BLANK}\p{{Nd}}+')
    THEN regexp_extract(reply, '\*\*Score:\*\*{_BLANK}(\p{{Nd}}+)', 1) END"""
_EXPLANATION = rf"""CASE WHEN regexp_matches(reply, '\*\*Explanation:\*\*')
    THEN regexp_extract(reply, '\*\*Explanation:\*\*{_BLANK}([^\n]*)', 1) END"""


def _mean(value: str) -> str:
    """Mean to two decimals, half up, in whole hundredths."""
    hundredths = f"sum(round({value} * 100)::bigint)"
    return f"(((2 * {hundredths} + count({value})) // (2 * count({value}))) / 100.0)::double::varchar"


def _averages(exclude: str, truncate: bool) -> str:
    score, seconds = (f"trunc({_NUMBER})", "trunc(time_s)") if truncate else (_NUMBER, "time_s")
    return f"""
averages AS (
  SELECT model, {_mean(score)} AS avg_score, {_mean(seconds)} || 's' AS avg_speed,
         count(*) FILTER (WHERE {_NUMBER} IS NULL) AS n_unscored
  FROM log WHERE {exclude} GROUP BY model)"""


_REPORT = f"""
{_averages("question <> 'q_function'", False)},
report AS (
  SELECT 0 AS section, model, upper(question) || ' - ' || input_prompt AS "Questions",
         CASE WHEN question = 'q_function' THEN '❌' ELSE score END AS score_text,
         time_s::varchar || 's' AS speed_text FROM log
  UNION ALL SELECT 1, model, 'Overall situation:', coalesce(avg_score, ''), '' FROM averages
  UNION ALL SELECT 2, model, ' Avg Speed:', avg_speed, '' FROM averages)"""


def _cosine_verdicts(source: str, key: str, left: str, right: str) -> str:
    """Score and justification of the token cosine of two texts per row of ``source``."""
    return f"""
{_counts('lt', source, key, _words(left))},
{_counts('rt', source, key, _words(right))},
cosines AS (
  SELECT k.id, CASE WHEN a.norm IS NOT NULL AND b.norm IS NOT NULL
                    THEN round(coalesce(d.dot, 0) / (a.norm * b.norm), 6) END AS cosine
  FROM (SELECT {key} AS id FROM {source}) k
  LEFT JOIN (SELECT l.id, sum(l.n * r.n) AS dot FROM lt l JOIN rt r ON l.id = r.id AND l.b = r.b GROUP BY 1) d ON d.id = k.id
  LEFT JOIN lt_norm a ON a.id = k.id LEFT JOIN rt_norm b ON b.id = k.id),
alike AS (
  SELECT id, CASE WHEN cosine IS NOT NULL THEN greatest(1, least(5, ceil(cosine * 5)))::int::varchar END AS score,
         'token cosine ' || printf('%.6f', cosine) AS explanation
  FROM cosines)"""


_FLOW = f"""
{_hits('asked_rag', 'query_id', 'text').strip()[5:]},
replies AS (
  SELECT q.row_id, q.model, q.question,
         CASE question WHEN 'q_rag' THEN 'rag' WHEN 'q_function' THEN 'function' ELSE 'normal' END AS answer_type,
         q.input_prompt,
         CASE WHEN question = 'q_rag' THEN {_rendered(RAG_TEMPLATE, {"context": "c.context", "question": "q.input_prompt"})}
              ELSE q.input_prompt END AS prompt
  FROM flow q LEFT JOIN contexts c ON q.question = 'q_rag' AND c.query_id = q.input_prompt),
weather AS (
  SELECT 'City' || (user_id % 5) AS city,
         'Weather in City' || (user_id % 5) || ' is ' || arg_max(event_type, ts) || ', ' || arg_max(value, ts)::varchar || '°C' AS sentence
  FROM events GROUP BY user_id % 5),
answers AS (
  SELECT row_id, model, question, answer_type, input_prompt,
         CASE WHEN contains(prompt, 'zu') THEN '❌'
              WHEN answer_type = 'function' THEN sentence
              ELSE {_echo('prompt')} END AS ai_output,
         contains(prompt, 'zu') AS failed,
         CASE WHEN contains(prompt, 'zu') THEN 'RuntimeError' END AS error
  FROM replies LEFT JOIN weather ON answer_type = 'function' AND contains(input_prompt, 'in ' || city || ' '))"""

_ASKED = """
flow AS (
  SELECT conv_id * 1000 + turn AS row_id, 'm' || (conv_id % 3) AS model, question,
         CASE WHEN question = 'q_function' THEN 'Weather in City' || (turn % 7) || ' now?' ELSE text END AS input_prompt
  FROM (SELECT *, (['q0','q1','q2','q3','q4','q5','q6','q_rag','q_function'])[conv_id % 9 + 1] AS question
        FROM conversations WHERE role = 'user')),
asked_rag AS (SELECT DISTINCT input_prompt AS query_id, input_prompt AS text FROM flow WHERE question = 'q_rag')"""

_RUBRIC = (
    "CASE question "
    + " ".join(
        f"WHEN '{key}' THEN " + _rendered(text, {"question": "input_prompt", "answer": "coalesce(ai_output, '')"})
        for key, text in RUBRICS.items()
    )
    + " END"
)

_NOT_EXCLUDED = "coalesce(question NOT IN (" + ", ".join(_text(q) for q in EXCLUDED) + "), true)"
_KEYED = "keyed AS (SELECT *, CASE WHEN conv_id % 8 < 7 OR turn % 4 > 0 THEN 'q' || (conv_id % 8) END AS question FROM qa)"

ORACLE: dict[str, str] = {
    "chunk_documents": f"WITH {_CHUNKS} SELECT id, doc_id, chunk_ix, len(cw)::int AS n_words, text FROM chunks",
    "chunk_stats_by_lang": f"""
WITH {_CHUNKS}
SELECT lang, count(*) AS n_chunks, sum(len(cw))::bigint AS n_words, round(avg(len(cw)), 6) AS avg_words
FROM chunks GROUP BY lang""",
    "word_hash_buckets": f"""
SELECT b::int AS bucket, count(*) AS n_words
FROM (SELECT unnest(list_transform({_words('text')}, {_HASHED})) AS b FROM documents) GROUP BY b""",
    "hash_embed_norm": f"""
WITH {_CHUNKS}, {_counts('ct', 'chunks', 'id', 'cw')}
SELECT id, sum(n * n)::bigint AS sq_norm, count(*)::int AS n_buckets FROM ct GROUP BY id""",
    "knn_top4": """
WITH sims AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id,
         list_cosine_similarity(q.embedding::double[], c.embedding::double[]) AS sim
  FROM embeddings q, embeddings c)
SELECT query_id, rank, id, round(sim, 6) AS sim
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id)::int AS rank FROM sims)
WHERE rank <= 4""",
    # The clustered search finds the same hits as the full one.
    "knn_clustered": """
WITH sims AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id,
         list_cosine_similarity(q.embedding::double[], c.embedding::double[]) AS sim
  FROM embeddings q, embeddings c)
SELECT query_id, rank, id, round(sim, 6) AS sim
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id)::int AS rank FROM sims)
WHERE rank <= 4""",
    "retrieve_chunks": _hits("benchmark", "item_id", "text") + " SELECT * FROM hits",
    # The inverted index finds the same hits as the dense search.
    "retrieve_inverted": _hits("benchmark", "item_id", "text") + " SELECT * FROM hits",
    "rag_context": _hits("benchmark", "item_id", "text") + " SELECT * FROM contexts",
    "rag_prompt": _hits(_TURNS, "query_id", "text")
    + f""" SELECT query_id, {_rendered(RAG_TEMPLATE, {"context": "context", "question": "t.text"})} AS prompt
FROM contexts JOIN {_TURNS} t USING (query_id)""",
    "qa_pairs": f"WITH {_QA} SELECT *, 'm0' AS model FROM qa",
    "chat_messages_json": """
SELECT conv_id, turn, 'system' AS first_role, 'user' AS second_role, text AS user_text
FROM conversations WHERE role = 'user'""",
    "route_answer_type": f"""
WITH {_LOG}
SELECT event_id, question,
       CASE question WHEN 'q_rag' THEN 'rag' WHEN 'q_function' THEN 'function' ELSE 'normal' END AS answer_type,
       CASE question WHEN 'q6' THEN 2000 ELSE 400 END AS max_tokens,
       CASE question WHEN 'q6' THEN 0.01::double ELSE 0.7::double END AS temperature
FROM log""",
    "config_questions": """
SELECT 'model ' || doc_id AS model, (i - 1)::int AS pos, 'q' || (i - 1) AS question, lines[i] AS input_prompt, 400 AS max_tokens
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""",
    "tool_call_parse": """
SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 2 ELSE 1 END AS n_calls,
       CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS argument
FROM events""",
    "tool_enrich_asof": """
SELECT e.event_id, e.user_id, v.value AS seen
FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
  ON e.user_id = v.user_id AND e.ts >= v.ts""",
    "judge_prompt": f"""
WITH {_QA}, {_KEYED}
SELECT conv_id, turn, question, {_RUBRIC} AS judge_prompt FROM keyed WHERE {_NOT_EXCLUDED} AND question <> 'q7'""",
    "judge_rejects": f"""
WITH {_QA}, {_KEYED}
SELECT conv_id, turn, question FROM keyed WHERE question = 'q7' OR question IS NULL""",
    "judge_parse": f"""
WITH {_QA}, replies AS (SELECT *, {_REPLY} AS reply FROM qa),
verdicts AS (SELECT conv_id, turn, {_SCORE} AS score, {_EXPLANATION} AS explanation FROM replies)
SELECT *, translate(score, '١٢٣٤٥', '12345')::double AS score_num FROM verdicts""",
    "judge_similarity": f"""
WITH answers AS (
  SELECT d.doc_id, d.text AS ai_output, b.text AS truth
  FROM documents d JOIN benchmark b ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id),
{_cosine_verdicts('answers', 'doc_id', 'ai_output', 'truth')}
SELECT id AS doc_id, score, explanation FROM alike""",
    "unjudged_answers": """
SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "results_union": f"""
WITH {_QA},
normal AS (SELECT *, {_REPLY} AS reply FROM qa WHERE conv_id % 2 = 0),
other AS (SELECT *, conv_id || '-' || turn AS row_id FROM qa WHERE conv_id % 2 = 1),
{_cosine_verdicts('other', 'row_id', 'ai_output', 'input_prompt')}
SELECT conv_id, turn, 'normal' AS answer_type, {_SCORE} AS score, {_EXPLANATION} AS explanation FROM normal
UNION ALL
SELECT conv_id, turn, 'rag', score, explanation FROM other JOIN alike ON id = row_id""",
    "relabel_sorted": f"""
WITH {_LOG}
SELECT event_id, CASE question WHEN 'q_rag' THEN 'RAG' WHEN 'q_function' THEN 'FUNCTION' ELSE question END AS question
FROM log ORDER BY question""",
    "summary_by_model": f"WITH {_UNEVEN}, {_averages(chr(39).join(['question IS DISTINCT FROM ', 'q_function', '']), False)} SELECT * FROM averages",
    "summary_truncated": f"WITH {_UNEVEN}, {_averages('true', True)} SELECT * FROM averages",
    "report_rows": f"WITH {_LOG}, {_REPORT} SELECT * FROM report",
    "report_pivot": f"""
WITH {_LOG.replace('log AS', 'whole AS', 1)},
log AS (SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY model, question ORDER BY inserted DESC) = 1),
{_REPORT}
SELECT "Questions",
"""
    + ",\n".join(
        f"coalesce(max(score_text) FILTER (WHERE model = '{m}'), '') AS {m}, "
        f"coalesce(max(speed_text) FILTER (WHERE model = '{m}'), '') AS \"{m} speed\""
        for m in ("m0", "m1", "m2")
    )
    + ' FROM report GROUP BY section, "Questions"',
    "latest_answer": f"""
WITH {_LOG}
SELECT model, question, event_id, time_s FROM log
QUALIFY row_number() OVER (PARTITION BY model, question ORDER BY inserted DESC, event_id DESC) = 1""",
    "model_report": f"""
WITH {_LOG.replace('log AS', 'whole AS', 1)},
log AS (
  SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY model, question ORDER BY inserted DESC, event_id DESC) = 1),
{_REPORT}
SELECT "Questions", coalesce(score_text, '') AS m0, coalesce(speed_text, '') AS "m0 speed", '' AS m1,
       row_number() OVER (ORDER BY section, "Questions", score_text, speed_text)::int AS position
FROM report WHERE model = 'm0'""",
    "stored_log": f"WITH {_LOG} SELECT event_id, model, question, score, count(*) OVER (PARTITION BY model) AS n_of_model FROM log",
    "index_sync": f"""
WITH {_CHUNKS}, {_counts('ct', 'chunks', 'id', 'cw')},
norms AS (SELECT id, sum(n * n)::bigint AS sq_norm FROM ct GROUP BY id)
SELECT id, sha256(text) AS content_hash, sq_norm FROM chunks JOIN norms USING (id)""",
    "generate_stub": f"""
SELECT conv_id, turn,
       CASE WHEN contains(text, 'zu') THEN '❌' ELSE {_echo('text')} END AS ai_output,
       CASE WHEN contains(text, 'zu') THEN 'RuntimeError' END AS error
FROM conversations WHERE role = 'user'""",
    "answer_flow": f"""
WITH {_ASKED}, {_FLOW}
SELECT model, question, answer_type, input_prompt, ai_output, failed, error FROM answers""",
    "judge_flow": f"""
WITH {_ASKED}, {_FLOW},
pending AS (SELECT * FROM answers WHERE {_NOT_EXCLUDED}),
compared AS (
  SELECT row_id, coalesce(ai_output, '') AS ai_output,
         CASE answer_type
              WHEN 'rag' THEN (SELECT string_agg(text, ' ' ORDER BY item_id) FROM benchmark WHERE 'm' || (item_id % 3) = model)
              ELSE (SELECT sentence FROM weather WHERE city = 'City0') END AS truth
  FROM pending WHERE answer_type <> 'normal'),
{_cosine_verdicts('compared', 'row_id', 'ai_output', 'truth')},
judged AS (
  SELECT row_id, (length(judge_prompt) % 5 + 1)::varchar AS score,
         'request of ' || length(judge_prompt) || ' characters' AS explanation
  FROM (SELECT row_id, {_RUBRIC} AS judge_prompt FROM pending WHERE answer_type = 'normal'))
SELECT p.model, p.question, p.answer_type, p.input_prompt, p.ai_output, v.score, v.explanation
FROM pending p JOIN (SELECT row_id, score, explanation FROM judged UNION ALL SELECT id, score, explanation FROM alike) v
  ON v.row_id = p.row_id""",
}
