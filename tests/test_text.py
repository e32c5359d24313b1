import math

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askmill.functions.text import check_window, question_label, relabel, render, render_each, words
from askmill.operators.chunks import chunk_documents, chunk_lengths

# White space as ``str.split`` sees it, between words of ASCII and other letters.
BLANKS = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\x85", "\xa0"]
BLANKS += [" ", " ", " ", " ", " ", " ", "　"]


def chunks_of(text, size=200, overlap=50):
    """The windows, counted out in plain Python."""
    tokens = text.split()
    return [" ".join(tokens[at : at + size]) for at in range(0, len(tokens), size - overlap)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_words_split_on_unicode_white_space(spark):
    text = "a" + "b".join(BLANKS) + " é​f "
    assert frame(spark, [text]).select(words(F.col("text"))).first()[0] == text.split()


@pytest.mark.parametrize("n", [0, 1, 149, 150, 151, 200, 201, 350, 2876])
def test_chunks_at_window_borders(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    rows = chunk_documents(frame(spark, [text])).orderBy("chunk_ix").collect()
    assert [r.text for r in rows] == chunks_of(text)
    assert [r.n_words for r in rows] == [len(c.split()) for c in chunks_of(text)]
    assert [r.id for r in rows] == [f"0_doc_{i + 1}" for i in range(len(rows))]
    assert len(rows) == math.ceil(n / 150)


def test_chunks_of_empty_and_null_text(spark):
    assert chunk_documents(frame(spark, ["", "   \n ", None])).count() == 0


def test_single_document_ids_and_kept_columns(spark):
    docs = frame(spark, ["one two three"]).withColumn("lang", F.lit("en"))
    row = chunk_documents(docs, size=2, overlap=1, single_document=True, keep=["lang"]).orderBy("chunk_ix").first()
    assert (row.id, row.lang, row.text) == ("doc_1", "en", "one two")


def test_contained_tail_can_be_left_out(spark):
    text = " ".join(f"w{i}" for i in range(2876))
    kept = chunk_documents(frame(spark, [text])).count()
    cut = chunk_documents(frame(spark, [text]), drop_contained_tail=True)
    assert kept == 20 and cut.count() == 19
    assert " ".join(text.split()[-20:]) in cut.orderBy(F.desc("chunk_ix")).first().text


def test_chunk_lengths_agree_with_chunks(spark):
    docs = frame(spark, [" ".join("x" * n for _ in range(n)) for n in (0, 1, 199, 200, 201, 777)])
    full = chunk_documents(docs).groupBy("doc_id").agg(F.sum("n_words").alias("n"), F.count("*").alias("c"))
    short = chunk_lengths(docs).groupBy("doc_id").agg(F.sum("n_words").alias("n"), F.count("*").alias("c"))
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, short.collect()))


@pytest.mark.parametrize("size,overlap", [(200, 200), (200, 300), (0, 0), (10, -1)])
def test_windows_that_never_advance_are_refused(size, overlap):
    with pytest.raises(ValueError):
        check_window(size, overlap)


@settings(max_examples=15, deadline=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    texts=st.lists(
        st.lists(st.sampled_from(["a", "bé", "c{", "日本", *BLANKS]), max_size=60).map("".join), min_size=1, max_size=8
    ),
    size=st.integers(1, 12),
    data=st.data(),
)
def test_any_text_and_window(spark, texts, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    got = {}
    for row in chunk_documents(frame(spark, texts), size, overlap).orderBy("doc_id", "chunk_ix").collect():
        got.setdefault(int(row.doc_id), []).append(row.text)
    assert got == {i: chunks_of(t, size, overlap) for i, t in enumerate(texts) if t.split()}


def test_templates_are_filled_once(spark):
    template = "Q: '{question}' A: '{answer}' again {question}."
    row = ("what {answer}?", "it’s {question} $1 \\1")
    df = spark.createDataFrame([(*row, template)], "q string, a string, t string")
    slots = {"question": F.col("q"), "answer": F.col("a")}
    expected = f"Q: '{row[0]}' A: '{row[1]}' again {row[0]}."
    assert df.select(render(template, slots)).first()[0] == expected
    assert df.select(render_each(F.col("t"), slots)).first()[0] == expected


@pytest.mark.parametrize("template", ["a {{q}} {q}", "{{{q}}} }}{{", "{{}}", "plain", "{q}{q}{{q"[:-3]])
def test_both_renderers_read_doubled_braces_alike(spark, template):
    df = spark.createDataFrame([("V{q}", template)], "q string, t string")
    slots = {"q": F.col("q")}
    expected = template.format(q="V{q}")
    assert df.select(render(template, slots), render_each(F.col("t"), slots)).first() == (expected, expected)


def test_templates_with_null_and_unknown_slots(spark):
    df = spark.createDataFrame([(None,)], "q string")
    assert df.select(render("<{q}>", {"q": F.col("q")})).first()[0] == "<>"
    assert df.select(render_each(F.lit("<{q}>{z}"), {"q": F.col("q")})).first()[0] == "<>{z}"
    with pytest.raises(KeyError):
        render("{nothing}", {"q": F.col("q")})


def test_labels(spark):
    df = spark.createDataFrame([("qr", "Why?"), ("q1", "How?")], "q string, p string")
    shown = relabel(F.col("q"), {"qr": "RAG", "qf": "FUNCTION"})
    assert [r[0] for r in df.select(question_label(shown, F.col("p"))).collect()] == ["RAG - Why?", "Q1 - How?"]
