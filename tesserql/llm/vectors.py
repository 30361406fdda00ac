"""Vectors in blocks: which take part, how rows become blocks, and how blocks meet blocks of queries.

A search is a grid: blocks of queries by groups of index blocks. Each cell is one task that holds one block of
queries, in slices, and one index block at a time; a cell returns one row a query with its best members, and these rows are merged.

Where the queries are a fixed share of the vectors, as in the registered searches, products and the copies of the index that are shuffled grow with the square of the vectors, the copies divided by QUERY_ROWS: an index of
n vectors and q queries moves n * q / QUERY_ROWS times the size of a vector's entry. That is the work asked for, all queries against all rows in blocks, and not made less here.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

BLOCK_ROWS = 8192
QUERY_ROWS = 16384
#: Queries that are compared with a block at once.
SLICE = 2048


def usable(column: str = "embedding") -> Column:
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(finite, F.lit(False))


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), dim of the vectors that take part; of rows with one vec_id the largest vector, so that repeated rows count once."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable())
    return rows.groupBy("vec_id").agg(F.max("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


BLOCK_SCHEMA = "dim int, block int, payload binary"


def blocks(rows: DataFrame, count: int, most: int, build: Callable[[np.ndarray, np.ndarray], list[bytes]]) -> DataFrame:
    """dim, block, payload: rows dealt by a hash to blocks of about `most` rows, each sorted by vec_id and built by `build(ids, vectors)` into payloads."""
    n = max(1, math.ceil(count / most))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).repartition(min(n, partitions(rows.sparkSession)), "dim", "block")
    dealt = dealt.sortWithinPartitions("dim", "block", "vec_id").select("dim", "block", "vec_id", "embedding")
    schema = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if key is not None:
                made = build(np.concatenate(ids), np.concatenate(vectors))
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(made), pa.int32()), pa.array([key[1]] * len(made), pa.int32()), pa.array(made, pa.binary())], schema=schema)

        for b in batches:
            dim, block = b["dim"].to_numpy(), b["block"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (dim[1:] != dim[:-1]) | (block[1:] != block[:-1])]) if len(b) else []
            for at, end in zip(starts, [*starts[1:], len(b)], strict=True):
                if key != (int(dim[at]), int(block[at])):
                    yield from close()
                    key, ids, vectors = (int(dim[at]), int(block[at])), [], []
                part = b.slice(at, end - at)
                ids.append(part["vec_id"].to_numpy())
                vectors.append(matrix(part["embedding"], key[0]))
        yield from close()

    return dealt.mapInArrow(run, BLOCK_SCHEMA)


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays in one byte string."""
    sink = pa.BufferOutputStream()
    for name, a in arrays.items():
        head = f"{name};{a.dtype.str};{','.join(map(str, a.shape))}".encode()
        raw = np.ascontiguousarray(a).tobytes()
        sink.write(len(head).to_bytes(4, "little") + head + len(raw).to_bytes(8, "little") + raw)
    return sink.getvalue().to_pybytes()


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        name, kind, shape = raw[at + 4 : at + 4 + n].decode().split(";")
        at += 4 + n
        n = int.from_bytes(raw[at : at + 8], "little")
        out[name] = np.frombuffer(raw, dtype=np.dtype(kind), count=n // np.dtype(kind).itemsize, offset=at + 8).reshape([int(x) for x in shape.split(",")])
        at += 8 + n
    return out


def distinct(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Equal vectors of a block once: v, and the ids of vector i in ids[start[i]:start[i + 1]], smallest first. ids come sorted."""
    raw = np.ascontiguousarray(vectors + 0.0)
    _, first, group = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    return {"ids": ids[order], "start": np.r_[0, np.cumsum(np.bincount(group))], "v": vectors[first]}


def plain(ids: np.ndarray, vectors: np.ndarray) -> list[bytes]:
    return [pack(ids=ids, v=vectors)]


def grid(queries: DataFrame, n_queries: int, index: DataFrame, n_index: int, k: int, cell: Callable, score_type: str) -> DataFrame:
    """query_id, rank, vec_id, score of every query's k best.

    cell(queries) returns an object with add(block) and best(), the latter (vec_ids, scores) of each query, best first.
    """
    spark, size = index.sparkSession, SLICE
    rows = max(1, math.ceil(n_queries / QUERY_ROWS))
    columns = max(1, min(math.ceil(partitions(spark) / rows), math.ceil(n_index / 1024)))
    kind = {"long": pa.int64(), "double": pa.float64()}[score_type]
    q = queries.select("dim", F.col("block").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("cg"), F.lit(-1).alias("block"), "payload")
    c = index.select("dim", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("qb"), F.pmod(F.col("block"), F.lit(columns)).alias("cg"), "block", "payload")
    cells = q.union(c).repartition(rows * columns, "dim", "qb", "cg").sortWithinPartitions("dim", "qb", "cg", "block")
    schema = pa.schema([("query_id", pa.int64()), ("vec_ids", pa.list_(pa.int64())), ("scores", pa.list_(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            for ids, part in held:
                found, scores = part.best()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(scores, pa.list_(kind))], schema=schema)

        for b in batches:
            for i in range(len(b)):
                at = tuple(b[c][i].as_py() for c in ("dim", "qb", "cg"))
                if at != key:
                    yield from close()
                    key, held = at, []
                block = unpack(b["payload"][i].as_py())
                if b["block"][i].as_py() < 0:
                    parts = [{c: x[lo : lo + size] for c, x in block.items()} for lo in range(0, len(block["ids"]), size)]
                    held = [(part["ids"].tolist(), cell(part)) for part in parts]
                else:
                    for _, part in held:
                        part.add(block)
        yield from close()

    found = cells.mapInArrow(run, f"query_id long, vec_ids array<long>, scores array<{score_type}>")
    # `columns` rows a query at most: each k members.
    pairs = F.transform(F.arrays_zip("vec_ids", "scores"), lambda x: F.struct((-x["scores"]).alias("o"), x["vec_ids"].alias("vec_id"), x["scores"].alias("score")))
    merged = found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k).alias("best"))
    ranked = merged.select("query_id", F.posexplode("best").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int, dtype):
        self.k = k
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * queries
        self.scores: list[np.ndarray] = [np.zeros(0, dtype)] * queries

    def offer(self, q: int, own: int, block: dict[str, np.ndarray], at: np.ndarray, scores: np.ndarray) -> None:
        """Vectors `at` of a block. Of equal vectors, only the k with the smallest ids besides the query's own can be among the k best."""
        if len(at) > self.k:
            best = scores >= np.partition(scores, len(at) - self.k - 1)[len(at) - self.k - 1]  # one may be the query's own
            at, scores = at[best], scores[best]
        start, end = block["start"][at], np.minimum(block["start"][at + 1], block["start"][at] + self.k + 1)
        n = end - start
        ids = block["ids"][np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(at) else np.zeros(0, np.int64)
        scores, other = np.repeat(scores, n), ids != own
        ids, scores = ids[other], scores[other]
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]

    def threshold(self) -> np.ndarray:
        """The k-th best score of each query; -inf with fewer."""
        return np.array([float(s[-1]) if len(s) == self.k else -np.inf for s in self.scores])
