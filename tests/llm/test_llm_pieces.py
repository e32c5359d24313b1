"""SentencePiece encoding by the prefix table against the library itself."""

import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from askmill.llm import piece_bpe
from askmill.llm.queries import op12_sentencepiece

MODEL = piece_bpe.load_model(public_tokenizers.path("piece_bpe_32k.model"))
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
ENCODER = piece_bpe.PrefixEncoder(MODEL)

TEXTS = [
    None,
    "",
    " ",
    "   ",
    "a",
    "  Hello   wörld\tx ﬁ ",
    "Ünïcödé 漢字かな 🙂👩‍👩‍👧 naïve   end \x1c\x1d \x00",
    "trailing newline\n",
    "x" * 30_000 + " y " * 5_000,
    "The quick brown fox, it's 12,345.67 (a)b [c]; d--e ... \"quote\" ‘s’ É. ß, ñ!",
    "The quick brown fox, it's 12,345.67 (a)b [c]; d--e ... \"quote\" ‘s’ É. ß, ñ!",
    "▁ already marked ▁▁ words",
]


def want(text):
    return LIBRARY.encode(text or "", add_bos=True, add_eos=True)


def test_texts_equal_the_library():
    for text in TEXTS:
        assert ENCODER.encode(text) == want(text), repr(text)[:60]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Zé.,'!\n\t -1 漢\r▁xyzthe"), max_size=60) | st.text(max_size=30))
def test_random_texts_equal_the_library(text):
    assert ENCODER.encode(text) == want(text)


def test_matches_come_longest_first_at_one_end():
    ends = {}
    for end, (_, size) in ENCODER.automaton.iter("▁international▁understanding▁▁▁▁of"):
        ends.setdefault(end, []).append(size)
    assert all(sizes == sorted(sizes, reverse=True) for sizes in ends.values())


def test_query_equals_the_library(spark, tmp_path):
    rows = [(i, t, "x", b"y") for i, t in enumerate(TEXTS)] + [(None, "no id", "x", b"y"), (3, "a", "x", b"y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, decoded binary")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(op12_sentencepiece(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    expected = []
    for doc_id, text, *_ in rows:
        ids = want(text)
        expected.append(
            (
                doc_id,
                len(ids),
                hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest(),
            )
        )
    expected.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [tuple(r) for r in got] == expected


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op12_sentencepiece(spark, str(tmp_path)).count() == 0
