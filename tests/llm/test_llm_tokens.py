"""Token files, packing and byte-level BPE against the whole-text encoders."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from askmill.llm import bpe, byte_bpe, minhash, packing, token_files, toxicity
from askmill.llm.bpe import PieceEncoder, byte_table, decode_bytes

JSON = byte_bpe.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
MULTI = byte_bpe.load_tokenizer(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
ENCODER, MULTI_ENCODER = PieceEncoder(JSON, words=64), PieceEncoder(MULTI, words=64)
WHOLE = Tokenizer.from_str(JSON)
WHOLE.encode_special_tokens = True


def ranks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})

TEXTS = [
    None,
    "",
    " ",
    "a",
    "word, next.\nLine two!  Two blanks \n \n\t tab",
    "<|endoftext|> it's they'll 'sabc don't",
    "Ünïcödé 漢字かな 🙂👩‍👩‍👧 naïve\u00a0space \u2028 end \x1c\x1d",
    "trailing newline\n",
    "trailing blanks   ",
    "x" * 30_000 + " y " * 5_000,
    "word, next.\nLine two!  Two blanks \n \n\t tab",
    "12,345.67 (a)b [c]; d--e ... \"quote\" ‘s’ É. ß, ñ!",
]


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def rows_of(spark, texts, extra=False):
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens bigint, part string")
    return df if extra else df.select("doc_id", "text")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Zé.,'!\n\t -1\u00a0漢\r"), max_size=40) | st.text(max_size=30))
def test_pieces_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids_of(text)
    assert np.frombuffer(MULTI_ENCODER.encode(text), "<u4").tolist() == TIKTOKEN.encode_ordinary(text)


@pytest.mark.parametrize("text", TEXTS)
def test_fixed_texts(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids_of(text)
    ids = MULTI_ENCODER.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(text or "")
    assert decode_bytes(byte_table(MULTI), ids) == (text or "").encode()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=2000), st.integers(9, 18))
def test_huffman_round_trip(ids, limit):
    counts = np.bincount(np.array(ids + [0], dtype=np.int64))
    code = token_files.Code(token_files.code_lengths(counts, limit))
    bits, checkpoints = code.encode(np.array(ids, dtype=np.int64))
    assert token_files.decode_segment(code.table(), code.bits, bits, checkpoints, len(ids)).tolist() == ids
    used = code.lengths[code.lengths > 0]
    assert used.max() <= limit and (2.0**-used).sum() <= 1


def test_lengths_are_least_under_the_limit():
    counts = np.array([1, 1, 2, 4, 8, 16, 32, 64, 0])
    assert token_files.code_lengths(counts, 18).tolist() == [7, 7, 6, 5, 4, 3, 2, 1, 0]
    assert token_files.code_lengths(counts, 3).tolist() == [3] * 8 + [0]
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(9, dtype=np.int64), 3)


def test_token_files_round_trip(spark, tmp_path):
    docs = rows_of(spark, TEXTS, extra=True).unionByName(rows_of(spark, ["null id"], True).withColumn("doc_id", F.lit(None).cast("bigint")))
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(docs.repartition(5), path, JSON, end_id=0)
    found = token_files.read_token_files(spark, path).orderBy("start").collect()
    expected, start = [], 0
    for doc, text in [(None, "null id"), *enumerate(TEXTS)]:
        ids = ids_of(text) + [0]
        expected.append((doc, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in found] == expected


def test_token_files_of_nothing_and_of_repeated_ids(spark, tmp_path):
    empty, same = f"file://{tmp_path}/empty", f"file://{tmp_path}/same"
    token_files.write_token_files(rows_of(spark, []), empty, JSON)
    assert token_files.read_token_files(spark, empty).count() == 0
    token_files.write_token_files(rows_of(spark, ["a b"] * 50).withColumn("doc_id", F.lit(7)), same, JSON)
    found = token_files.read_token_files(spark, same).orderBy("start").collect()
    assert [r.start for r in found] == list(range(0, 150, 3)) and {r.n_tokens for r in found} == {3}


def check_packing(found, texts, capacity, longest, max_documents, max_attention, end_id=2):
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in enumerate(texts):
        ids, at = ids_of(text) + [end_id], 0
        for i, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            piece = ids[at : at + r.length]
            assert (r.piece, r.start, len(piece)) == (i, at, r.length)
            assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
            assert i == 0 or r.length == longest
            at += r.length
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and len(rows) <= max_documents and sum(r.length**2 for r in rows) <= max_attention


@pytest.mark.parametrize(
    "text",
    ["a\nb\n\nc d\n e\n", "word%%% été&&& a.### it's$ x'***' <|a|> b<c>\nd%\n%e\n'll", "\nfirst\tline \nlast\x85", " a\nb", "\n", "a\r\nb\n\tc"],
)
def test_lines_and_marks(text):
    assert np.frombuffer(ENCODER.encode(text), dtype="<u4").tolist() == ids_of(text)
    assert np.frombuffer(MULTI_ENCODER.encode(text), dtype="<u4").tolist() == TIKTOKEN.encode(text)


def test_words_need_no_second_tokenizer_and_lines_no_memory():
    encoder = PieceEncoder(JSON)
    encoder.whole = None  # only for what has no safe cut
    encoder.bare.update({mark: b"" for mark in (".", "%%%")})
    encoder.encode("alpha beta.\ngamma%%% naïve")
    assert set(encoder.spaced) == {"beta", "beta.", "naïve"}
    assert set(encoder.bare) == {"alpha", "gamma", "gamma%%%", ".", "%%%"}


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(1024, 1024, 1 << 20), (64, 3, 1500), (16, 2, 100)])
def test_packing(spark, rule, caps):
    capacity, max_documents, max_attention = caps
    longest = min(capacity, int(max_attention**0.5))
    found = packing.pack(rows_of(spark, TEXTS, True), JSON, capacity, max_documents, max_attention, 2, rule).collect()
    check_packing(found, TEXTS, capacity, longest, max_documents, max_attention)


def test_packing_of_nothing_and_in_several_groups(spark):
    assert packing.pack(rows_of(spark, []), JSON).count() == 0
    texts = [f"w{i} " * (i % 40 + 1) for i in range(200)]
    found = packing.pack(rows_of(spark, texts), JSON, capacity=128, max_attention=1 << 20, group=50).collect()
    check_packing(found, texts, 128, 128, 1024, 1 << 20)


def test_best_fit_comes_near_the_bound():
    lengths = np.random.default_rng(1).integers(1, 1024, 3000)
    sequence, _ = packing.best_fit(lengths, 1024, 1024, 1 << 20)
    assert sequence.max() + 1 <= 1.02 * lengths.sum() / 1024


def test_byte_bpe_query_columns(spark):
    docs = rows_of(spark, TEXTS, True)
    found = byte_bpe.decode(byte_bpe.encode(docs, MULTI), MULTI).orderBy("doc_id").collect()
    for r, text in zip(found, TEXTS):
        ids = TIKTOKEN.encode_ordinary(text or "")
        assert (r.n_tokens, bytes(r.ids), bytes(r.decoded)) == (len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode())
        assert r.part == "x"
    assert byte_bpe.encode(rows_of(spark, []), MULTI).count() == 0
    back = byte_bpe.decode_text(byte_bpe.decode(byte_bpe.encode(docs, MULTI), MULTI)).orderBy("doc_id").collect()
    assert [r.text for r in back] == [t or "" for t in TEXTS]


def test_offsets_and_split_characters(spark):
    row = byte_bpe.encode(rows_of(spark, ["né 🙂"]), MULTI, offsets=True).first()
    assert len(row.starts) == len(row.ends) == row.n_tokens and row.ends[-1] == 4
    ids = np.frombuffer(bytes(row.ids), "<u4")
    # A character cut off at the end of the ids is replaced, its first part and the rest together are whole.
    table = byte_table(MULTI)
    cut = decode_bytes(table, ids[:-1].astype("<u4").tobytes())
    assert "🙂".encode() not in cut and hashlib.sha256(decode_bytes(table, ids.tobytes())).digest() == hashlib.sha256("né 🙂".encode()).digest()


def test_a_worker_remembers_for_one_operator_at_a_time():
    PieceEncoder.of(JSON, 64).encode("one two")
    assert bpe._loaded
    minhash.shingle_set("one two", 1)
    list(minhash._sign(1, 4, 4)(iter([])))
    assert not bpe._loaded
    minhash.shingle_set("one two", 1)
    assert minhash._hashes
    toxicity._automaton(toxicity.ToxicityModel(["one"], []))
    assert not minhash._hashes and toxicity._automata
    PieceEncoder.of(JSON, 64)
    assert not toxicity._automata


def test_pieces_do_not_depend_on_the_words_remembered(spark):
    few, many = (packing.pack(rows_of(spark, TEXTS), JSON, words=words).drop("sequence_id", "offset").collect() for words in (8, 1 << 16))
    assert sorted(map(tuple, few)) == sorted(map(tuple, many))


def test_the_pipeline_hands_small_batches_to_python_unless_told_otherwise(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        corpus_pipeline.prepare(spark)
        assert int(spark.conf.get(name)) == corpus_pipeline.BATCH
        spark.conf.set(name, 7)
        corpus_pipeline.prepare(spark)
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
