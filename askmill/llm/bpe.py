"""Byte-level BPE in tasks, with the ids of frequent words remembered.

A text is cut where the tokenizer's own pattern always cuts, so that encoding
the pieces one by one gives the ids of the whole text:

* before a single space that follows and precedes a non-space,
* around a single newline between two non-spaces,
* between a Latin letter and the punctuation that ends its piece.

A text with other white space is cut at the first kind of place only.
"""

from __future__ import annotations

import base64
import json
import re
import sys
from array import array
from itertools import islice

import numpy as np

from askmill.llm import remembered

#: Pieces remembered by a Python worker.
WORDS = 1_000_000
_PLAIN_CUT = re.compile(r"(?<=\S) (?=\S)")
# Never part of a piece that began with letters; an apostrophe may be.
_MARKS = ".,;:!?#$%&*|<>"
_loaded: dict[tuple, PieceEncoder] = {}


def byte_characters() -> str:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256))


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a file with lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizer of the tokenizers library for ranks: all splits of a token into two tokens are merges of its rank."""
    character = byte_characters()
    shown = {token: "".join(character[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        cuts.sort(key=lambda cut: (ranks[cut[0]], ranks[cut[1]]))
        merges += [[shown[a], shown[b]] for a, b in cuts]
    return json.dumps(
        {
            "version": "1.0",
            "truncation": None,
            "padding": None,
            "added_tokens": [],
            "normalizer": None,
            "pre_tokenizer": {
                "type": "Sequence",
                "pretokenizers": [
                    {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
                    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
                ],
            },
            "post_processor": None,
            "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
            "model": {
                "type": "BPE",
                "dropout": None,
                "unk_token": None,
                "continuing_subword_prefix": None,
                "end_of_word_suffix": None,
                "fuse_unk": False,
                "byte_fallback": False,
                "ignore_merges": True,
                "vocab": {shown[token]: rank for token, rank in ranks.items()},
                "merges": merges,
            },
        }
    )


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def is_word(piece: str) -> bool:
    """Letters of Latin scripts only."""
    return piece.isalpha() and (piece.isascii() or max(piece) < "ɐ")


class _Memory(dict):
    """Ids by piece. When it is full, the pieces met since the last time stay one round longer."""

    def __init__(self, find, size: int) -> None:
        self.find, self.size, self.before = find, size, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.before.get(key)
        if ids is None:
            ids = self.find(key)
        if len(self) >= self.size:
            self.before = dict(self)
            self.clear()
        self[key] = ids
        return ids


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, tokenizer_content: str, words: int = WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_content)
        self.tokenizer.encode_special_tokens = True
        self.single = self._for_single(tokenizer_content)
        character = byte_characters()
        self.space, self.shown = character[32], {b: character[b] for b in range(256)}
        self.spaced = _Memory(self._spaced, words // 2)
        self.bare = _Memory(self._bare, words // 8)
        self.newline = self.whole("\n")

    @classmethod
    def of(cls, tokenizer_content: str, words: int = WORDS) -> PieceEncoder:
        """The encoder of this Python worker, kept from task to task."""
        remembered.only("bpe", _loaded.clear)
        key = (hash(tokenizer_content), len(tokenizer_content), words)
        if key not in _loaded:
            _loaded[key] = cls(tokenizer_content, words)
        return _loaded[key]

    def _for_single(self, tokenizer_content: str):
        """Ids of a piece that the pattern leaves whole, in byte characters already.

        The merges alone give them, without a second tokenizer, unless the
        tokenizer normalises texts or has words of its own.
        """
        from tokenizers import Tokenizer

        content = json.loads(tokenizer_content)
        if content["normalizer"] is None and all(token["special"] for token in content["added_tokens"]):
            merge = self.tokenizer.model.tokenize
            return lambda shown: [token.id for token in merge(shown)]
        single = Tokenizer.from_str(json.dumps({**content, "pre_tokenizer": None}))
        return lambda shown: single.encode(shown, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str, before: str) -> bytes:
        """The ids of Latin letters after an optional space: one piece of the pattern."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        return packed(self.single(before + shown))

    def _parts(self, memory: _Memory, piece: str) -> bytes | None:
        """The ids of ``piece`` from its parts, where it has a safe cut."""
        if "\n" in piece:
            left, _, right = piece.partition("\n")
            if left and right and not left[-1].isspace() and not right[0].isspace():
                return memory[left] + self.newline + self.bare[right]
        word = piece.rstrip(_MARKS)
        if word and word != piece and word[-1] < "ɐ" and word[-1].isalpha():
            return memory[word] + self.bare[piece[len(word) :]]
        return None

    def _spaced(self, piece: str) -> bytes:
        if piece.isalpha():
            if piece.isascii():
                return packed(self.single(self.space + piece))
            if is_word(piece):
                return self._word(piece, self.space)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _OddSpace
        parts = self._parts(self.spaced, piece)
        return self.whole(" " + piece) if parts is None else parts

    def _bare(self, piece: str) -> bytes:
        if is_word(piece):
            return self._word(piece, "")
        parts = self._parts(self.bare, piece)
        return self.whole(piece) if parts is None else parts

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        # Empty lines are white space of more than one character: ``_line`` takes such a text in one.
        lines = [text] if "\n\n" in text else text.split("\n")
        try:
            return self.newline.join([self._line(line) for line in lines])
        except _OddSpace:
            first, *rest = _PLAIN_CUT.split(text)
            return self.whole(first) + b"".join([self._odd(piece) for piece in rest])

    def _line(self, line: str) -> bytes:
        """The ids of a line that neither begins nor ends with white space; lines in it go by :meth:`_parts`."""
        pieces = line.split(" ")
        first = pieces[0]
        if not first or first[0].isspace() or first[-1].isspace():
            raise _OddSpace
        return self.bare[first] + b"".join(map(self.spaced.__getitem__, islice(pieces, 1, None)))

    def _odd(self, piece: str) -> bytes:
        return self.whole(" " + piece) if piece[-1].isspace() else self.spaced[piece]


class _OddSpace(Exception):
    """A piece has white space at its ends."""


def decode_bytes(table: list[bytes], ids: bytes) -> bytes:
    """The bytes of ids. Characters that several tokens share come out whole, since the bytes are joined first."""
    return b"".join(map(table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def byte_table(tokenizer_content: str) -> list[bytes]:
    """Token bytes by id: the characters of the vocabulary turned back into the bytes they stand for."""
    byte = {character: b for b, character in enumerate(byte_characters())}
    content = json.loads(tokenizer_content)
    vocabulary = content["model"]["vocab"]
    table = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, number in vocabulary.items():
        table[number] = bytes(byte[character] for character in token)
    for token in content["added_tokens"]:
        table += [b""] * (token["id"] + 1 - len(table))
        table[token["id"]] = token["content"].encode()
    return table
