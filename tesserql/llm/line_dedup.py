"""Line dedup: lines that many documents share go; what is returned are keep bitmaps, not texts.

The digests of all lines are range-partitioned by (digest, document) and sorted within each partition by document
and position. One pass streams each partition: it counts a digest's documents as it meets their first
occurrences and reports the positions to drop. The ranges split a digest that fills several partitions
between documents, so no partition gets more than its share of a hot line and counts of its parts add up; what
a partition can't decide alone (its first and last digest) it reports with its counts, two rows a
partition, and these are added up afterwards. The result is one bit a line, packed and compressed, per document.

Defined results: a null or empty text is one empty line; a line whose key (stripped, A-Z lower-cased) is
empty is never dropped; a row is known by its doc_id (null counts as an id) together with its text, so exactly
repeated rows count as one document and get the same bitmap; an empty table gives an empty result; further columns
are passed through by `apply_keep` and ignored by `keep_bitmaps`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, batch, int64s, nullable, partitions, raw_texts, stage, table

MIN_DOCUMENTS = 10

LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("tx", pa.int64()), ("pos", pa.int32())])
FOUND = pa.schema([("kind", pa.int8()), *LINES, ("n", pa.int64())])
DROP, OPEN, PART, HEAD = 0, 1, 2, -1


def lines_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line with a key, and one with pos HEAD that holds the number of lines in h1, for each document."""
    digest = xxhash.xxh3_128_digest
    for b in batches:
        ids, null, tx = int64s(b["doc_id"]), b["doc_id"].is_null().to_numpy(zero_copy_only=False), int64s(b["tx"])
        raw, pos, owner = [], [], []
        for i, text in enumerate(raw_texts(b["text"])):
            lines = lines_of(text)
            raw.append(len(lines).to_bytes(8, "little") + bytes(8))
            pos.append(HEAD)
            owner.append(i)
            for k, line in enumerate(lines):
                if key := line.strip(SPACES).lower():
                    raw.append(digest(key))
                    pos.append(k)
                    owner.append(i)
            if len(raw) > 200_000:
                yield _lines(raw, pos, owner, ids, null, tx)
                raw, pos, owner = [], [], []
        yield _lines(raw, pos, owner, ids, null, tx)


def _lines(raw: list[bytes], pos: list[int], owner: list[int], ids: np.ndarray, null: np.ndarray, tx: np.ndarray) -> pa.RecordBatch:
    h, at = np.frombuffer(b"".join(raw), dtype=np.int64).reshape(-1, 2), np.asarray(owner, dtype=np.int64)
    return batch(LINES, h[:, 0], h[:, 1], nullable(ids[at], null[at]), tx[at], np.asarray(pos, dtype=np.int32))


def stream_runs(least: int):
    """Over sorted rows: DROP for each line of a digest that `least` documents hold; OPEN and PART for what the partition's first and last digest leave undecided."""

    def report(kind: int, rows: pa.RecordBatch | pa.Table, n: int = 0) -> pa.RecordBatch:
        rows = rows.combine_chunks().to_batches()[0] if isinstance(rows, pa.Table) else rows
        return batch(FOUND, np.full(len(rows), kind, np.int8), *rows.columns, np.full(len(rows), n, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, count, held, first = None, None, 0, [], True  # of the run that the last batch left open; held: its rows, while undecided

        def close(edge: bool) -> Iterator[pa.RecordBatch]:
            if held and edge:
                yield report(OPEN, pa.Table.from_batches(held))
            if edge:
                yield batch(FOUND, [PART], [key[0]], [key[1]], [None], [0], [0], [count])

        for b in batches:
            if not len(b):
                continue
            h1, h2, tx = int64s(b["h1"]), int64s(b["h2"]), int64s(b["tx"])
            doc, null = int64s(b["doc_id"]), b["doc_id"].is_null().to_numpy(zero_copy_only=False)
            new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_key | np.r_[True, (doc[1:] != doc[:-1]) | (null[1:] != null[:-1]) | (tx[1:] != tx[:-1])]
            starts = np.flatnonzero(new_key)
            ends = np.r_[starts[1:], len(b)]
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            at = 0
            if key == (h1[0], h2[0]):  # the open run goes on
                docs[0] -= (doc[0], null[0], tx[0]) == last
                docs[0] += count
                if held and docs[0] >= least:
                    yield report(DROP, pa.Table.from_batches(held))
                    held = []
            elif key is not None:
                yield from close(first)
                held, first = [], False
            # every run that ends in this batch and isn't the partition's first is decided here; the last one stays open
            whole = np.repeat(docs >= least, ends - starts)
            if len(starts) > 1:
                if first:
                    part = b.slice(0, ends[0])
                    key, count = (int(h1[0]), int(h2[0])), int(docs[0])
                    if docs[0] < least:
                        held.append(part)
                    yield from close(True)
                    held, first = [], False
                else:
                    held = []
                at = starts[-1]
            if whole.any():
                yield report(DROP, b.filter(pa.array(whole)))
            key, count, last = (int(h1[-1]), int(h2[-1])), int(docs[-1]), (doc[-1], null[-1], tx[-1])
            if docs[-1] < least:
                held.append(b.slice(at))
        if key is not None:
            yield from close(True)

    return run


def known(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's hash, which together with doc_id knows a row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tx"))


def keep_bitmaps(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, tx, n_lines, n_dropped, keep: for each document a bit a line (1: it stays), packed and deflated."""
    n = partitions(docs.sparkSession)
    lines = stage(known(docs).mapInArrow(line_keys, "h1 long, h2 long, doc_id long, tx long, pos int"), "lines")
    keyed = lines.where(F.col("pos") != HEAD).repartitionByRange(n, "h1", "h2", "doc_id", "tx").sortWithinPartitions("h1", "h2", "doc_id", "tx", "pos")
    found = stage(keyed.mapInArrow(stream_runs(min_documents), "kind byte, h1 long, h2 long, doc_id long, tx long, pos int, n long"), "found")
    # Two parts a partition at most.
    many = found.where(F.col("kind") == PART).groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_documents).select("h1", "h2")
    late = found.where(F.col("kind") == OPEN).join(many, ["h1", "h2"], "left_semi")
    drops = found.where(F.col("kind") == DROP).select("doc_id", "tx", "pos").union(late.select("doc_id", "tx", "pos"))
    drops = drops.groupBy("doc_id", "tx").agg(F.collect_set("pos").alias("drops"))
    heads = lines.where(F.col("pos") == HEAD).select(F.col("doc_id").alias("d"), F.col("tx").alias("t"), F.col("h1").alias("n_lines")).distinct()
    both = heads.join(drops, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tx")), "left")
    return both.select(F.col("d").alias("doc_id"), F.col("t").alias("tx"), "n_lines", "drops").mapInArrow(_pack, "doc_id long, tx long, n_lines long, n_dropped long, keep binary")


PACKED = pa.schema([("doc_id", pa.int64()), ("tx", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps, dropped = [], []
        for n, drops in zip(b["n_lines"].to_pylist(), b["drops"], strict=True):
            bits = np.ones(n, dtype=bool)
            if drops.is_valid:
                bits[drops.values.to_numpy()] = False
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            dropped.append(int(n - bits.sum()))
        yield batch(PACKED, b["doc_id"], b["tx"], b["n_lines"], pa.array(dropped, pa.int64()), maps)


def apply_keep(docs: DataFrame, bitmaps: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with what the bitmaps keep as text (a null one is empty then); the numbers of lines and of those dropped follow the columns of docs, under names that these don't have."""
    maps = bitmaps.select(F.col("doc_id").alias("_tq_d"), F.col("tx").alias("_tq_t"), F.col("n_lines").alias("_tq_n"), F.col("n_dropped").alias("_tq_x"), F.col("keep").alias("_tq_k"))
    on = docs["doc_id"].cast("long").eqNullSafe(maps["_tq_d"]) & (F.xxhash64(docs["text"]) == maps["_tq_t"])
    both = docs.join(maps.hint("shuffle_hash"), on, "left").drop("_tq_d", "_tq_t")
    names = docs.columns
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, x, keep in zip(raw_texts(b["text"]), b["_tq_x"].to_pylist(), b["_tq_k"], strict=True):
                if x:
                    bits, lines = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), dtype=np.uint8)), lines_of(text)
                    text = b"\n".join([line for line, bit in zip(lines, bits, strict=False) if bit])
                texts.append((text or b"").decode("utf-8", "replace"))
            columns = [pa.array(texts, pa.string()) if c == "text" else b[c] for c in names]
            yield pa.RecordBatch.from_arrays([*columns, b["_tq_n"], b["_tq_x"]], names=[*names, n_lines, n_dropped])

    return both.mapInArrow(cut, f"{own}, `{n_lines}` long, `{n_dropped}` long")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_keep(docs, keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
many AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT doc_id, pos, line, k IN (SELECT k FROM many) AS gone FROM keyed)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
