"""Toxicity from a learned lexicon, with misspellings and quotation.

``fit`` learns from labelled documents, at most ``MAX_LABELLED`` of them:

* a lexicon: words, and stems that begin words, of documents marked toxic far
  more often than of others,
* a logistic regression on how many words of a document hit the lexicon exactly,
  within the edit distance allowed for their length, or by a stem, and on how
  many hits stand in quotation.

Hits are found by a Levenshtein automaton that runs on the trie of the lexicon.
Its states are sets of trie nodes with the edits spent; they are made when first
met and remembered, so a word costs one look-up a character until it can no
longer match.

A null or empty text has no hits and gets the score of such a text. Rows with
repeated or null ids each get their own score. An empty table gives an empty
table. Without labelled documents of both kinds nothing can be learned: all
scores are then the share of toxic labels (0 without labels). Texts are read
whole; no other column is used for a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askmill.llm import remembered
from askmill.llm.byte_bpe import with_columns

#: Labelled documents that a model is fitted on, chosen by a hash of their ids.
MAX_LABELLED = 12_000
#: A document with this score or more is toxic.
TOXIC = 0.7
#: Entries of a lexicon.
MAX_ENTRIES = 2_000
#: Shortest and longest stem.
STEM = (4, 8)
#: A hit counts as quoted between quotation marks at most this many characters away.
QUOTED_WITHIN = 60
#: Words of the window before and after a hit that may announce a quotation.
CUES = frozenset({"said", "says", "wrote", "quote", "quoted", "called", "calling", "word", "term", "insult"})
CUE_WORDS = 4
_WORD = re.compile(r"[^\W_]+")
_OPEN, _CLOSE = "\"“„«‘", "\"”“»’"
_REMEMBERED = 300_000
EXACT, FUZZY, BY_STEM = 1, 2, 3
N_FEATURES = 7


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """Finds the best entry for a word: exact, by stem, or within the edits its length allows."""

    def __init__(self, words: list[str], stems: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.word_edits: dict[int, int] = {}
        self.stem_ends: set[int] = set()
        for word in words:
            self.word_edits[self._insert(word)] = allowed_edits(word)
        for stem in stems:
            self.stem_ends.add(self._insert(stem))
        self.most = max(self.word_edits.values(), default=0)
        self._reset()

    def _insert(self, term: str) -> int:
        node = 0
        for character in term:
            if character not in self.children[node]:
                self.children[node][character] = len(self.children)
                self.children.append({})
            node = self.children[node][character]
        return node

    def _reset(self) -> None:
        self.memory: dict[str, int] = {}
        self.moves: dict[tuple[int, str], int] = {}
        self.states: list[dict[int, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state, after missing characters were allowed for; -1 if nothing is left."""
        waiting = list(nodes)
        while waiting:
            node = waiting.pop()
            spent = nodes[node] + 1
            if spent <= self.most:
                for child in self.children[node].values():
                    if nodes.get(child, spent + 1) > spent:
                        nodes[child] = spent
                        waiting.append(child)
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(nodes)
        return self.numbers[key]

    def _step(self, state: int, character: str) -> int:
        after: dict[int, int] = {}

        def reach(node: int, spent: int) -> None:
            if spent <= self.most and after.get(node, spent + 1) > spent:
                after[node] = spent

        for node, spent in self.states[state].items():
            reach(node, spent + 1)
            for letter, child in self.children[node].items():
                reach(child, spent if letter == character else spent + 1)
        return self._state(after)

    def match(self, word: str) -> int:
        """0, or the kind of the hit."""
        found = self.memory.get(word)
        if found is None:
            if len(self.memory) >= _REMEMBERED or len(self.states) >= _REMEMBERED:
                self._reset()
            found = self.memory[word] = self._match(word)
        return found

    def _match(self, word: str) -> int:
        state, plain, by_stem = self.start, 0, False
        for character in word:
            plain = self.children[plain].get(character, -1) if plain >= 0 else -1
            by_stem = by_stem or plain in self.stem_ends
            move = self.moves.get((state, character))
            if move is None:
                move = self.moves[state, character] = self._step(state, character)
            state = move
            if state < 0:
                # Only stems can still be met, along the plain path.
                if plain < 0 or by_stem:
                    break
        if plain in self.word_edits:
            return EXACT
        if by_stem:
            return BY_STEM
        if state >= 0 and any(spent <= self.word_edits.get(node, -1) for node, spent in self.states[state].items()):
            return FUZZY
        return 0


@dataclass
class ToxicityModel:
    words: list[str]
    stems: list[str]
    weights: list[float] = field(default_factory=lambda: [0.0] * N_FEATURES)
    bias: float = 0.0
    mean: list[float] = field(default_factory=lambda: [0.0] * N_FEATURES)
    scale: list[float] = field(default_factory=lambda: [1.0] * N_FEATURES)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.mean) / self.scale) @ np.asarray(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether a hit stands between quotation marks, or just after a word that announces a quotation."""
    before, after = text[max(0, start - QUOTED_WITHIN) : start], text[end : end + QUOTED_WITHIN]
    opened = max(before.rfind(mark) for mark in _OPEN)
    if opened >= 0 and any(mark in after for mark in _CLOSE) and (before.count('"') % 2 or before[opened] != '"'):
        return True
    return not CUES.isdisjoint(_WORD.findall(before)[-CUE_WORDS:])


def features(automaton: LexiconAutomaton, text: str | None) -> list[float]:
    lowered = (text or "").lower()
    words = _WORD.findall(lowered)
    memory, match = automaton.memory, automaton.match
    hits = {word for word in set(words) if (memory.get(word) if word in memory else match(word))}
    counts, quoted = [0, 0, 0, 0], 0
    if hits:
        kinds = {word: match(word) for word in hits}
        for found in _WORD.finditer(lowered):
            kind = kinds.get(found.group())
            if kind:
                if _quoted(lowered, *found.span()):
                    quoted += 1
                else:
                    counts[kind] += 1
    share = 100 / max(1, len(words))
    named = counts[EXACT] + counts[FUZZY]
    raw = [counts[EXACT], counts[FUZZY], counts[BY_STEM], quoted, named * share, counts[BY_STEM] * share, len(words)]
    return [float(x) for x in np.log1p(raw)]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label with each word and stem, over the rows of a task."""
    totals: dict[str, list[int]] = {}
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            words = {w for w in _WORD.findall((text or "").lower()) if len(w) >= STEM[0]}
            terms = {"=" + w for w in words} | {w[:k] for w in words for k in range(STEM[0], min(STEM[1], len(w)) + 1)}
            for term in terms:
                totals.setdefault(term, [0, 0])[label] += 1
        if len(totals) > 500_000:
            yield _term_batch(totals)
            totals = {}
    yield _term_batch(totals)


def _term_batch(totals: dict[str, list[int]]) -> pa.RecordBatch:
    columns = [pa.array(list(totals), pa.string()), *(pa.array([n[i] for n in totals.values()], pa.int64()) for i in (0, 1))]
    return pa.RecordBatch.from_arrays(columns, names=["term", "clean", "toxic"])


def choose_terms(found: list[tuple[str, int, int]]) -> tuple[list[str], list[str]]:
    """Words and stems of ``(term, clean, toxic)``, words marked by ``=``; a stem is left out if one longer entry explains it."""
    toxic = {term: t for term, _, t in found}
    longer: dict[str, int] = {}
    for term, t in toxic.items():
        base = term[1:] if term[0] == "=" else term[:-1]
        longer[base] = max(longer.get(base, 0), t)
    stems: list[str] = []
    for term in sorted((t for t in toxic if t[0] != "="), key=lambda t: (len(t), t)):
        if longer.get(term, 0) < 0.9 * toxic[term] and not any(term.startswith(s) for s in stems):
            stems.append(term)
    words = sorted(t[1:] for t in toxic if t[0] == "=" and not any(t[1:].startswith(s) for s in stems))
    return words, stems


def _regress(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps."""
    design = np.c_[x, np.ones(len(x))]
    beta, ridge = np.zeros(design.shape[1]), np.full(design.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        gradient = design.T @ (y - p) - ridge * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta[:-1], float(beta[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_labelled: int = MAX_LABELLED,
    min_documents: int = 5,
    min_share: float = 0.02,
    min_lift: float = 8.0,
) -> ToxicityModel:
    """Learn from the documents that ``labels(doc_id, <label>)`` marks 0 or 1; an id with both marks counts as toxic.

    An entry of the lexicon is in at least ``min_documents`` toxic documents and in
    ``min_share`` of them (a stem in twice as many), and ``min_lift`` times more
    often in those than in others.
    """
    marked = (
        labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    n = marked.count()
    buckets = 1 << 30
    bound = min(buckets, buckets * max_labelled // max(1, n))
    chosen = F.broadcast(marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)) < bound))
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = source.join(chosen, "doc_id").select("text", "label")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        share = toxic / max(1, clean + toxic)
        return ToxicityModel([], [], bias=float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    counted = rows.mapInArrow(_count_terms, "term string, clean bigint, toxic bigint")
    totals = counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1))
    stem = ~F.col("term").startswith("=")
    least = max(min_documents, min_share * toxic)
    telling = totals.where((F.col("toxic") >= F.when(stem, 2 * least).otherwise(least)) & (lift >= min_lift))
    best = telling.orderBy(F.desc(lift), "term").limit(MAX_ENTRIES)
    words, stems = choose_terms([tuple(r) for r in best.collect()])
    model = ToxicityModel(words, stems)
    # At most max_labelled rows of seven numbers.
    table = with_features(rows, model).select("features", "label").toArrow()
    x = np.array(table.column("features").to_pylist())
    y = np.asarray(table.column("label"), dtype=np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    weights, bias = _regress((x - mean) / scale, y)
    return ToxicityModel(words, stems, weights.tolist(), bias, mean.tolist(), scale.tolist())


_automata: dict[tuple, LexiconAutomaton] = {}


def _automaton(model: ToxicityModel) -> LexiconAutomaton:
    remembered.only("toxicity", _automata.clear)
    key = (tuple(model.words), tuple(model.stems))
    if key not in _automata:
        _automata.clear()
        _automata[key] = LexiconAutomaton(model.words, model.stems)
    return _automata[key]


def with_features(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Append ``features``: logarithms of the hits by kind, quoted hits, hits per hundred words, and words."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        automaton = _automaton(shared.value)
        return [pa.array([features(automaton, t) for t in texts.to_pylist()], pa.list_(pa.float64()))]

    return with_columns(df, make, [T.StructField("features", T.ArrayType(T.DoubleType()))], [text])


def with_score(df: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """Append ``score`` from 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        model = shared.value
        automaton = _automaton(model)
        rows = np.array([features(automaton, t) for t in texts.to_pylist()]).reshape(-1, N_FEATURES)
        return [pa.array(model.score(rows))]

    return with_columns(df, make, [T.StructField(score, T.DoubleType())], [text])
