"""Nearest chunks of each question, exact, by an inverted index of non-negative vectors.

The index is dealt into blocks, and each block is kept as postings: for every
bucket the list of its rows ``(row, weight)``, ``weight`` being the component
over the vector's length, and the greatest weight of the list. A question then
needs only some lists: its bucket ``b`` can add at most ``q_b * greatest_b`` to
any chunk's cosine. Ordering its lists by that bound, the shortest run of small
ones whose bounds sum below a floor ``tau`` can only hold chunks that score
under ``tau``; the other lists are essential. Their weights are summed list by
list, and only chunks whose sum and the bounds left out reach ``tau`` are
scored, in full, by their vectors. ``tau`` is a true lower bound of the
question's ``k``-th best in the block: the ``k``-th best exact score among the
few chunks of greatest weight in each of its lists.

All components must be non-negative (word counts are). Chunks that share no
bucket with a question score 0 and come after all others, chunks without
length score NULL and come last; the smallest ids fill a question's ``k``
places from them when fewer chunks score above 0. The result equals that of
:func:`askmill.operators.retrieve.nearest`, whose work items bring the blocks
together: postings live in the task that searches them and are never shuffled,
what leaves an item is ``k`` rows per question, and no list is longer than a
block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from askmill.operators.retrieve import TIE_DECIMALS, _matrix, _search

#: Postings of one bucket a block holds at most.
PART_ROWS = 200_000
#: Bytes of vectors in a block; its postings take about as many again.
BLOCK_BYTES = 16 << 20
#: A floor a little under ``tau``, so that rounding to ``TIE_DECIMALS`` cannot lose a tie.
SLACK = 1e-7


class _Lists:
    """The postings of a block: rows and weights, bucket after bucket."""

    def __init__(self, vectors: np.ndarray, norms: np.ndarray, k: int) -> None:
        has_length = np.flatnonzero(norms > 0)
        # Bucket by bucket, so that each list is one slice.
        bucket, at = np.nonzero(vectors[has_length].T)
        self.rows = has_length[at]
        self.weights = vectors[self.rows, bucket] / norms[self.rows]
        self.starts = np.searchsorted(bucket, np.arange(vectors.shape[1] + 1))
        self.greatest = np.zeros(vectors.shape[1])
        self.heads = []
        for b in range(vectors.shape[1]):
            rows, weights = self.of(b)
            head = np.argpartition(weights, -k)[-k:] if len(weights) > k else slice(None)
            self.heads.append(rows[head])
            self.greatest[b] = weights.max(initial=0.0)

    def of(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.starts[bucket], self.starts[bucket + 1])
        return self.rows[own], self.weights[own]


class _ListSearch:
    """Runs in a task: the best ``k`` chunks of an index block for each question, by the block's lists."""

    def __init__(self, shared, k: int) -> None:
        self.shared, self.k = shared, k

    def _candidates(self, lists: _Lists, query: np.ndarray, norm: float, scores) -> np.ndarray:
        """Rows that may be among the best ``k`` scores above 0."""
        terms = np.flatnonzero(query)
        if not len(terms):
            return terms
        bounds = query[terms] / norm * lists.greatest[terms]
        first = np.unique(np.concatenate([lists.heads[b] for b in terms]))
        tau = np.partition(scores(first), -self.k)[-self.k] - SLACK if len(first) >= self.k else -np.inf
        order = np.lexsort((terms, bounds))
        reach = np.cumsum(bounds[order])
        spared = int(np.searchsorted(reach, tau, side="left"))
        sums = np.zeros(len(self.norms))
        for b in terms[order[spared:]]:
            rows, weights = lists.of(b)
            sums[rows] += weights * (query[b] / norm)
        rest = reach[spared - 1] if spared else 0.0
        return np.flatnonzero((sums > 0) & (sums + rest >= tau - SLACK))

    def _best(self, lists: _Lists, query: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and similarities of the block's best; NaN where a vector has no length."""
        if not norm > 0:
            rows = self.by_id[: self.k]
            return rows, np.full(len(rows), np.nan)

        def scores(rows: np.ndarray) -> np.ndarray:
            return (self.vectors[rows] @ query) / (norm * self.norms[rows])

        found = self._candidates(lists, query, norm, scores)
        sims = scores(found)
        best = np.lexsort((self.place[found], -np.round(sims, TIE_DECIMALS)))[: self.k]
        found, sims = found[best], sims[best]
        if len(found) < self.k:
            # Places left: chunks that share no bucket, then chunks without length, by id.
            unused = np.ones(len(self.norms), dtype=bool)
            unused[found] = False
            spare = self.by_id[unused[self.by_id]]
            zero = self.norms[spare] > 0
            more = np.concatenate([spare[zero][: self.k], spare[~zero][: self.k]])[: self.k - len(found)]
            found = np.concatenate([found, more])
            sims = np.concatenate([sims, np.where(self.norms[more] > 0, 0.0, np.nan)])
        return found, sims

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, q_norms = self.shared.value
        block = pa.Table.from_batches(batches)
        ids = block.column("id").combine_chunks()
        self.norms = np.nan_to_num(np.asarray(block.column("norm").combine_chunks(), dtype=np.float64))
        self.vectors = _matrix(block.column("embedding").combine_chunks())
        self.by_id = np.argsort(np.asarray(ids.to_pylist()), kind="stable")
        self.place = np.empty(len(ids), dtype=np.int64)
        self.place[self.by_id] = np.arange(len(ids))
        lists = _Lists(self.vectors, self.norms, self.k)
        hits = [self._best(lists, query, norm) for query, norm in zip(queries, q_norms)]
        asked = np.repeat(np.arange(len(hits)), [len(rows) for rows, _ in hits])
        rows, sims = (np.concatenate(side) for side in zip(*hits))
        yield pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(asked)), ids.take(pa.array(rows)), pa.array(sims, mask=np.isnan(sims))],
            names=["query_id", "id", "sim"],
        )


def nearest_inverted(queries: DataFrame, index: DataFrame, k: int = 4, dim: int | None = None) -> DataFrame:
    """``(query_id, rank, id, sim)``: the ``k`` chunks of highest cosine per question, as :func:`nearest` gives them.

    ``queries`` holds ``query_id, embedding, norm``, ``index`` holds ``id,
    embedding, norm``; all components at least 0. Rows without an embedding
    take no part. ``dim`` is the length of the vectors, if known.
    """
    return _search(queries, index, k, dim, BLOCK_BYTES, _ListSearch, PART_ROWS)[0]


def retrieve_inverted(questions: DataFrame, index: DataFrame, embedder=None, text: str = "text", k: int = 4) -> DataFrame:
    """``(query_id, rank, id, sim, text)`` for ``questions(query_id, <text>)``, by the inverted index.

    The same embedder, one of non-negative components, must have built the index.
    """
    from askmill.functions.vectors import HashingEmbedder
    from askmill.operators.retrieve import attach_text
    from askmill.operators.vectors import embed

    embedder = embedder or HashingEmbedder()
    hits, n_hits = _search(embed(questions, text, embedder), index, k, embedder.dim, BLOCK_BYTES, _ListSearch, PART_ROWS)
    return attach_text(hits, index, n_hits)
