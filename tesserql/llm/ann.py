"""Approximate maximum-inner-product search: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

A product quantiser gives each pair of dimensions a code of four bits. Its loss weighs a residual's part along
the vector ETA times as much as the part across it, as that part alone moves the largest inner products; codes
and centres are found by coordinate descent on that loss. The quantiser is fitted on at most SAMPLE
vectors (the first in the order of a hash); every vector is encoded. A search adds, for each
byte of codes, one entry of a query's table to all queries of a block at once, and scores exactly, on the original vectors in double precision, those that
are among the query's RERANK best by these sums of all different vectors that its cell has met so far: of B blocks of a cell that is about RERANK * (1 + 1/2 + ... + 1/B) vectors a query,
whatever the number of vectors.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; a vector meets only vectors of its
own length; of rows with one vec_id the largest vector counts, so repeated rows count once; rows without vec_id take no part; equal scores go to
the smaller vec_id, also where thousands of vectors are equal; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .vectors import BLOCK_ROWS, QUERY_ROWS, Best, blocks, distinct, grid, pack, plain, taking_part

K = 20
EVERY = 20
SAMPLE = 4096
RERANK = 256
CENTRES = 16
WIDTH = 2
THRESHOLD = 0.2
#: ETA for short vectors, where the threshold alone would give plain product quantisation.
LEAST_ETA = 2.0
ROUNDS = 8


class Quantiser:
    """centres[subspace, code, WIDTH]"""

    def __init__(self, centres: np.ndarray, eta: float):
        self.centres, self.eta = centres, eta

    @staticmethod
    def split(v: np.ndarray) -> np.ndarray:
        """[vector, subspace, WIDTH], padded with zeros to whole bytes of codes."""
        pad = -v.shape[1] % (2 * WIDTH)
        return np.pad(v, ((0, 0), (0, pad))).reshape(len(v), -1, WIDTH)

    def encode(self, v: np.ndarray, codes: np.ndarray | None = None, rounds: int = 2) -> np.ndarray:
        """Coordinate descent over the subspaces, from the nearest centres."""
        x = self.split(v)
        u = x / np.maximum(np.sqrt((x**2).sum(axis=(1, 2), keepdims=True)), 1e-30)
        if codes is None:
            codes = np.stack([((x[:, m, None] - c[None]) ** 2).sum(-1).argmin(1) for m, c in enumerate(self.centres)], axis=1)
        residual = x - np.stack([c[codes[:, m]] for m, c in enumerate(self.centres)], axis=1)
        along = (u * residual).sum(-1)
        total = along.sum(1)
        for _ in range(rounds):
            for m, c in enumerate(self.centres):
                r = x[:, m, None] - c[None]
                part = np.einsum("nd,nkd->nk", u[:, m], r)
                cost = (r**2).sum(-1) + (self.eta - 1) * ((total - along[:, m])[:, None] + part) ** 2
                codes[:, m] = cost.argmin(1)
                now = part[np.arange(len(x)), codes[:, m]]
                total += now - along[:, m]
                along[:, m] = now
        return codes

    @classmethod
    def fit(cls, v: np.ndarray, rounds: int = ROUNDS) -> Quantiser:
        """From a sample, in which equal vectors count once; the same sample gives the same quantiser."""
        v = np.unique(v, axis=0)
        dim = v.shape[1]
        eta = max(LEAST_ETA, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        x = cls.split(v)
        rng = np.random.default_rng(0)
        centres = np.stack([x[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), m] for m in range(x.shape[1])])
        own = cls(centres, eta)
        u = x / np.maximum(np.sqrt((x**2).sum(axis=(1, 2), keepdims=True)), 1e-30)
        codes = None
        for _ in range(rounds):
            codes = own.encode(v, codes, 1)
            for m in range(x.shape[1]):
                decoded = np.stack([c[codes[:, i]] for i, c in enumerate(own.centres)], axis=1)
                along = (u * (x - decoded)).sum(-1)
                rest = along.sum(1) - along[:, m]
                for k in range(CENTRES):
                    mine = codes[:, m] == k
                    if not mine.any():
                        continue
                    um, xm = u[mine, m], x[mine, m]
                    left = mine.sum() * np.eye(WIDTH) + (eta - 1) * um.T @ um
                    right = xm.sum(0) + (eta - 1) * (um * (rest[mine] + (um * xm).sum(1))[:, None]).sum(0)
                    own.centres[m, k] = np.linalg.solve(left, right)
        return own


def encode_block(quantisers: dict[int, np.ndarray], etas: dict[int, float]):
    def build(ids: np.ndarray, vectors: np.ndarray) -> list[bytes]:
        dim, own = vectors.shape[1], distinct(ids, vectors)
        vectors = own["v"]
        codes = np.concatenate([Quantiser(quantisers[dim], etas[dim]).encode(vectors[at : at + 2048]) for at in range(0, len(vectors), 2048)])
        return [pack(**own, codes=(codes[:, 0::2] + CENTRES * codes[:, 1::2]).astype(np.uint8))]

    return build


def cell_of(quantisers: dict[int, np.ndarray], k: int = K):
    class Cell:
        def __init__(self, queries: dict[str, np.ndarray]):
            self.ids, self.v = queries["ids"], queries["v"]
            self.kept = Best(len(self.ids), k, float)
            self.top = np.full((len(self.ids), RERANK), -np.inf, dtype=np.float32)
            self.reranked = 0

        def tables(self) -> np.ndarray:
            """Two codes of four bits a byte: the sum of their entries, for all queries. Made for each block, as the tables of a whole block of queries would not fit."""
            pairs = np.einsum("qmd,mkd->mkq", Quantiser.split(self.v), quantisers[self.v.shape[1]]).astype(np.float32)
            return (pairs[1::2, :, None] + pairs[0::2, None]).reshape(len(pairs) // 2, CENTRES * CENTRES, len(self.ids))

        def add(self, block: dict[str, np.ndarray]) -> None:
            codes, v, tables = block["codes"], block["v"], self.tables()
            sums = np.zeros((len(v), len(self.ids)), dtype=np.float32)
            for at in range(0, len(v), 512):
                for m in range(codes.shape[1]):
                    sums[at : at + 512] += tables[m][codes[at : at + 512, m]]
            sums = sums.T
            for at in range(0, len(self.ids), 256):
                part, top = np.ascontiguousarray(sums[at : at + 256]), self.top[at : at + 256]
                near = np.argpartition(part, len(v) - RERANK, axis=1)[:, len(v) - RERANK :] if len(v) > RERANK else np.tile(np.arange(len(v)), (len(part), 1))
                sure = np.take_along_axis(part, near, axis=1)
                top[:] = np.partition(np.concatenate([top, sure], axis=1), sure.shape[1], axis=1)[:, sure.shape[1] :]
                among = sure >= top.min(axis=1)[:, None]
                self.reranked += int(among.sum())
                for i, row in enumerate(near, at):
                    row = row[among[i - at]]
                    self.kept.offer(i, self.ids[i], block, row, (v[row] * self.v[i]).sum(axis=1))

        def best(self) -> tuple[list, list]:
            return [x.tolist() for x in self.kept.ids], [x.tolist() for x in self.kept.scores]

    return Cell


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query by inner product, ties to the smaller vec_id."""
    rows = stage(taking_part(vectors).where(F.exists("embedding", lambda x: x != 0)), "vectors")
    asked = rows.where(is_query)
    n, m = rows.count(), asked.count()
    quantisers, etas = {}, {}
    for dim in [r["dim"] for r in rows.select("dim").distinct().collect()]:
        sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()["embedding"]
        own = Quantiser.fit(np.concatenate([c.flatten().to_numpy() for c in sample.chunks]).reshape(-1, dim))
        quantisers[dim], etas[dim] = own.centres, own.eta
    index = stage(blocks(rows, n, BLOCK_ROWS, encode_block(quantisers, etas)), "codes")
    return grid(blocks(asked, m, QUERY_ROWS, plain), m, index, n, k, cell_of(quantisers, k), "double")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
