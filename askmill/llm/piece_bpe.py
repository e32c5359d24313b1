"""SentencePiece BPE encoding by a prefix table of last tokens, and decoding, over Arrow batches.

SentencePiece's BPE merges, again and again, the adjacent pair whose joined
string is a piece of the highest score (the leftmost of equal ones). Its
result has a property that makes it linear: the encoding of every prefix of
a text ends in one token only, and a token ``t`` ending at ``e`` is that last
token exactly when it is compatible with the last token of the prefix that
ends where ``t`` starts (encoding the two pieces' strings gives back those two
tokens), or when ``t`` is a whole prefix that encodes to itself. So one pass
over the text fills a table of last tokens: an Aho-Corasick automaton of all
pieces gives the candidates that end at each place, and the first compatible
one, longest first, is kept. The ids are then read backwards from the end,
each last token leading to the prefix before it.

A character that is no piece is a boundary no merge crosses; it becomes the
``<0xXX>`` tokens of its UTF-8 bytes (byte fallback), or ``<unk>`` in a model
without them. The text is first normalised as the model says; only models
with the ``identity`` rule are taken (others are refused), which adds one
``▁`` before a non-empty text and turns each blank into ``▁``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import regex
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from askmill.llm.byte_bpe import share, with_columns

#: The piece types of SentencePiece's model file, fixed by its format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Most compatibility verdicts a worker keeps; the table is emptied when it is full.
PAIR_CACHE = 1 << 20
#: Most encoded chunks a worker keeps, and the longest chunk kept; the table is emptied when it is full.
CHUNK_CACHE, CHUNK_CHARS = 1 << 18, 64


class PrefixEncoder:
    """Encodes texts as a SentencePiece BPE model does, without sampling."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != 2:
            raise ValueError("not a BPE model")
        spec = proto.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only the identity normaliser, without removal of blanks, is supported")
        self.dummy_prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.unk = 0
        for i, p in enumerate(proto.pieces):
            if p.type in (NORMAL, USER_DEFINED):
                self.ids[p.piece] = i
                self.score[p.piece] = p.score
            elif p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
            elif p.type == UNKNOWN:
                self.unk = i
        self.bos = next(i for i, p in enumerate(proto.pieces) if p.piece == "<s>")
        self.eos = next(i for i, p in enumerate(proto.pieces) if p.piece == "</s>")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.whole = {i for piece, i in self.ids.items() if self.merge(piece) == [piece]}
        self.pairs: dict[int, bool] = {}
        # No piece holds a character before a word mark other than these, so no merge crosses a
        # cut before a word mark that follows any other character: the text's chunks are encoded
        # apart, and a repeated chunk once.
        before_mark = sorted({a for piece in self.ids for a, b in zip(piece, piece[1:]) if b == "▁"})
        guard = "".join(regex.escape(c) for c in before_mark)
        self.cut = regex.compile(f"(?<![{guard}])(?=▁)" if guard else "(?=▁)")
        self.chunks: dict[str, list[int]] = {}

    def merge(self, text: str) -> list[str]:
        """The library's rule on a short string: best-scoring join first, the leftmost of equals."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                score = self.score.get(symbols[k] + symbols[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are what their joined string encodes to."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            a, b = self.pieces[left], self.pieces[right]
            known = self.merge(a + b) == [a, b]
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return ("▁" if self.dummy_prefix else "") + text.replace(" ", "▁")

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text`` (a null one is empty), with the begin and end ids."""
        out = [self.bos]
        for chunk in self.cut.split(self.normalise(text or "")):
            if not chunk:
                continue
            ids = self.chunks.get(chunk)
            if ids is None:
                ids = self.encode_chunk(chunk)
                if len(chunk) <= CHUNK_CHARS:
                    if len(self.chunks) >= CHUNK_CACHE:
                        self.chunks.clear()
                    self.chunks[chunk] = ids
            out.extend(ids)
        out.append(self.eos)
        return out

    def encode_chunk(self, norm: str) -> list[int]:
        """Ids of a normalised string, by the table of the last token of each of its prefixes."""
        n = len(norm)
        # The last token of each prefix; -1: none, as after a character that is no piece. The
        # automaton reports matches by their end, and at one end the longest first, so the first
        # compatible one decides a place and the others are passed over.
        last = [-2] * (n + 1)
        last[0] = -1
        for end, (token, size) in self.automaton.iter(norm):
            e = end + 1
            if last[e] != -2:
                continue
            before = last[e - size]
            if (token in self.whole) if before < 0 else self.compatible(before, token):
                last[e] = token
        out: list[int] = []
        e = n
        while e > 0:
            token = last[e]
            if token >= 0:  # -2 (no candidate fits) cannot be left by a valid model; it is a lone character
                out.append(token)
                e -= len(self.pieces[token])
            else:
                raw = norm[e - 1].encode("utf-8")
                out.extend(reversed([self.bytes[b] for b in raw]) if self.bytes else [self.unk])
                e -= 1
        out.reverse()
        return out


_loaded: dict[str, tuple[PrefixEncoder, object]] = {}


def _tools(model: bytes) -> tuple[PrefixEncoder, object]:
    """The encoder and the library's decoder of one model, kept per worker in one slot."""
    import hashlib

    import sentencepiece

    key = hashlib.sha256(model).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = (PrefixEncoder(model), sentencepiece.SentencePieceProcessor(model_proto=model))
    return _loaded[key]


def load_model(path: str) -> bytes:
    with open(os.fspath(path), "rb") as file:
        return file.read()


def encode_decode(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Append ``n_tokens`` (long), ``ids`` (binary: little-endian unsigned 32-bit) and ``decoded`` (string).

    Every row is kept, repeated ones and those with a null id too; a null text
    is an empty one, which gives the begin and end ids only. Texts of any
    length are encoded whole. ``decoded`` is the library's decoding of the ids.
    Columns named like an output column are replaced.
    """
    shared = share(df.sparkSession, model)

    def make(texts: pa.Array) -> list[pa.Array]:
        encoder, decoder = _tools(shared.value)
        counts, blobs, decoded = [], [], []
        for value in texts.to_pylist():
            ids = encoder.encode(value)
            counts.append(len(ids))
            blobs.append(np.asarray(ids, dtype="<u4").tobytes())
            decoded.append(decoder.decode(ids))
        return [pa.array(counts, pa.int64()), pa.array(blobs, pa.binary()), pa.array(decoded, pa.string())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return with_columns(df, make, fields, [text])


def batches_of(texts: list[str | None], model: bytes) -> Iterator[list[int]]:
    """Encodings of plain strings on the driver, for tests and small checks."""
    encoder, _ = _tools(model)
    for text in texts:
        yield encoder.encode(text)
