"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Components become integers, floor(256 * x). A vector is a document, a dimension a term, and a component a posting whose
impact is its magnitude, quantised to its number of bits. The index keeps, for each block of vectors, one
posting segment an impact level, and for each vector the norm of what lies below each level. A search processes
segments by descending impact and adds them to the accumulators of the queries of its block. After a level, what is left of
a score is at most the query's norm times the vector's remaining norm; a vector leaves only when its bound is below the k-th
proven score. A query for which few vectors are possible is done with the block: they are rescored exactly with integers. Lower levels are added only for the
queries that go on and the vectors that are possible for one of them. The first levels, after which nothing can be proven yet, are added together.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; a vector meets only vectors of
its own length; of rows with one vec_id the largest vector counts, so repeated rows count once; rows without vec_id take no part; scores
outside 64 bits count as its limits; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .vectors import BLOCK_ROWS, QUERY_ROWS, Best, blocks, distinct, grid, pack, plain, taking_part

K = 5
SCALE = 256
EVERY = 50
#: Possible members a query, at which the rest of the levels is left to rescoring.
FEW = 64
#: Bounds aren't looked at while more than this part of the largest norm is unprocessed.
LOOSE = 0.25
LIMIT = 2**63 - 1
NEAR_LIMIT = LIMIT * (1 - 1e-9)


#: Components from here on are compared with Python's integers, without an index.
HUGE = 2.0**62


def integers(v: np.ndarray) -> np.ndarray:
    scaled = np.floor(SCALE * v)
    if np.abs(scaled).max(initial=0) < HUGE:
        return scaled.astype(np.int64)
    return np.array([[int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(SCALE * x)) for x in row] for row in v.tolist()], dtype=object).reshape(v.shape)


def build_index(ids: np.ndarray, vectors: np.ndarray) -> list[bytes]:
    """One block: the postings of all levels, highest first, and each vector's norm below each level."""
    own = distinct(ids, vectors)
    v = integers(own["v"])
    if v.dtype == object:
        return [pack(ids=own["ids"], start=own["start"], raw=own["v"])]
    level = np.where(v, np.frexp(v.astype(float))[1], 0).astype(np.int8)
    flat, order = level.ravel(), np.argsort(-level.ravel(), kind="stable")
    order = order[: np.count_nonzero(flat)]
    levels = np.unique(flat[order])[::-1]
    ends = np.searchsorted(-flat[order], -levels, side="right")
    below = np.stack([np.sqrt((v.astype(float) ** 2 * (level < x)).sum(axis=1)) for x in levels]) if len(levels) else np.zeros((0, len(v)))
    impact = v.ravel()[order]
    impact = impact.astype(np.int32) if np.abs(impact).max(initial=0) < 2**31 else impact
    return [pack(ids=own["ids"], start=own["start"], shape=np.array(v.shape), posting=order.astype(np.int32), impact=impact, ends=ends.astype(np.int64), below=below)]


class Cell:
    """A block of queries and its best members so far; `touched` counts products of a posting or, in rescoring, a component with a query."""

    def __init__(self, queries: dict[str, np.ndarray], k: int = K):
        self.ids, self.raw = queries["ids"], queries["v"]
        self.q = integers(self.raw)
        self.k, self.kept, self.touched = k, Best(len(self.ids), k, np.int64), 0
        self.floats = self.q.astype(float)
        self.norm = np.sqrt((self.floats**2).sum(axis=1))

    def rescore(self, block: dict[str, np.ndarray], v: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        """Exactly: the query rows[i] with the vector columns[i] of the block. Sorted by rows."""
        scores = np.empty(len(rows), dtype=np.int64)
        small = v.dtype != object and self.q.dtype != object and np.abs(v).max(initial=0).astype(float) * np.abs(self.q).max(initial=0) * v.shape[1] < HUGE
        for at in range(0, len(rows), 1 << 18):
            part = slice(at, at + (1 << 18))
            if small:
                scores[part] = np.einsum("ij,ij->i", self.q[rows[part]], v[columns[part]])
            else:
                scores[part] = [max(-LIMIT, min(LIMIT, int(x))) for x in (self.q[rows[part]].astype(object) * v[columns[part]].astype(object)).sum(axis=1)]
        self.touched += len(rows) * v.shape[1]
        for i in np.unique(rows).tolist():
            lo, hi = np.searchsorted(rows, [i, i + 1])
            self.kept.offer(i, self.ids[i], block, columns[lo:hi], scores[lo:hi])

    def add(self, block: dict[str, np.ndarray]) -> None:
        if "raw" in block or self.q.dtype == object or not len(block["ends"]):
            v = integers(block["raw"]) if "raw" in block else self.vectors(block)
            self.rescore(block, v, *np.divmod(np.arange(len(self.q) * len(v)), len(v)))
            return
        v = self.vectors(block)
        n, dim = v.shape
        # The queries and vectors that go on, their sums, and the postings that wait to be added.
        rows, columns, sums, waiting = np.arange(len(self.q)), np.arange(n), np.zeros((len(self.q), n)), np.zeros(n * dim)
        proven = self.kept.threshold()
        largest, last = np.sqrt((v.astype(float) ** 2).sum(axis=1).max()), len(block["ends"]) - 1
        for x, end in enumerate(block["ends"]):
            start = block["ends"][x - 1] if x else 0
            waiting[block["posting"][start:end]] = block["impact"][start:end]
            if block["below"][x].max() > LOOSE * largest and x < last:
                continue  # nothing can be proven yet
            segment = waiting.reshape(n, dim)[columns]
            sums += self.floats[rows] @ segment.T
            self.touched += len(rows) * int(np.count_nonzero(segment))
            waiting[:] = 0
            # The sums' own rounding is far below a part in 10^9 of the norms.
            left = self.norm[rows][:, None] * (block["below"][x][columns] * (1 + 1e-9) + largest * 1e-12)[None, :] + 1e-3
            # One vector more than k, as one may be the query's own.
            few = self.k + 1
            if len(columns) > few:
                proven[rows] = np.maximum(proven[rows], np.partition(sums - left, len(columns) - few, axis=1)[:, len(columns) - few])
            # Scores beyond the limits of 64 bits are ties.
            bar = np.where(proven[rows] <= -NEAR_LIMIT, -np.inf, np.minimum(proven[rows], NEAR_LIMIT))
            possible = sums + left >= bar[:, None]
            counts = possible.sum(axis=1)
            done = (counts <= FEW) | (x == last)
            own, at = np.nonzero(possible[done])
            self.rescore(block, v, rows[done][own], columns[at])
            if done.all():
                return
            on = possible[~done].any(axis=0)
            rows, columns, sums = rows[~done], columns[on], sums[np.ix_(~done, on)]

    @staticmethod
    def vectors(block: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(int(block["shape"].prod()), dtype=np.int64)
        out[block["posting"]] = block["impact"]
        return out.reshape(block["shape"])

    def best(self) -> tuple[list, list]:
        return [x.tolist() for x in self.kept.ids], [x.tolist() for x in self.kept.scores]


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the largest integer inner product of each query, ties to the smaller vec_id."""
    rows = stage(taking_part(vectors), "vectors")
    asked = rows.where(is_query)
    n, m = rows.count(), asked.count()
    index = stage(blocks(rows, n, BLOCK_ROWS, build_index), "impacts")
    return grid(blocks(asked, m, QUERY_ROWS, plain), m, index, n, k, partial(Cell, k=k), "long")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INT AS rank, vec_id, score::BIGINT AS score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
WHERE rank <= 5
"""
