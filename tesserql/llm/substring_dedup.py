"""Substring dedup: the earliest occurrence of a passage stays, the others go.

Units are normalised, their digests are grouped over all documents, and of each digest the occurrence of the earliest document is kept. Whole lines miss passages inside lines, so
a unit here is a paragraph that the words themselves cut: words are split at white space and lower-cased (A-Z), the pairs of words that have the least hash of any WINDOW pairs that follow one another
are cuts, and from each cut a unit reaches over the first cut that makes it LEAST words long. Where a passage begins and ends in its host's lines or sentences doesn't matter: copies of it have the same cuts, but
for those within WINDOW words of its ends. So what is reported is exact both ways:

* a passage of at least LEAST + 2 * WINDOW - 2 words, so of over 50, that an earlier document has is found, but for fewer than WINDOW words where it begins and 2 * WINDOW where it ends;
* every word reported lies in a unit of at least LEAST words that an earlier document has word for word; nothing between two repeated units goes with them.

The 128-bit digests are range-partitioned with (document, place) and sorted, so one pass over each partition meets a digest's occurrences in rank order: the first is kept, the others are reported
with the document that keeps it. A digest that several partitions share is settled in a second pass over what was found: its first rows in each of its partitions, two a partition at most, say which is
the first of all, so a hot passage never meets in one task, and nothing is joined. Units that overlap or touch are listed as one span, with its offsets in the original text.

Defined results: a null or empty text, or one of fewer than LEAST words, has no units; a row is known by its doc_id (null counts as an id, the first in rank) together with its text, so exactly repeated
rows are one document and keep or lose the same spans, and rows of one id with different texts are two; a document's own repeats stay; an empty table gives an empty result; further columns
are ignored by `repeated_passages` and passed through by `remove_spans`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import int64s, nullable, partitions, raw_texts, stage, table
from .shingles import M2, M3, mix, stretch_hashes, words_of

#: Words of a unit at least.
LEAST = 33
#: Of so many pairs of words that follow one another, one at least is a cut.
WINDOW = 10

UNITS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("tx", pa.int64()), ("k", pa.int32()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
UNITS_DDL = "h1 long, h2 long, doc_id long, tx long, k int, words int, start int, end int"
RANK = ("doc_id", "tx", "k")
FOUND = pa.schema([*UNITS, ("first_doc", pa.int64()), ("first_tx", pa.int64()), ("edge", pa.bool_())])
FOUND_DDL = UNITS_DDL + ", first_doc long, first_tx long, edge boolean"
SPANS_DDL = "doc_id long, tx long, start int, end int, words int, first_doc_ids array<long>"


def cuts(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the words that begin a pair with the least hash (the last of equal ones) of some `window` pairs."""
    r = mix(h[:-1] * M3 + mix(h[1:]))
    if not len(r):
        return np.zeros(0, dtype=np.int64)
    window = min(window, len(r))
    n = len(r) - window + 1
    best, at = r[:n].copy(), np.arange(n)
    for j in range(1, window):
        less = r[j : j + n] <= best
        np.copyto(best, r[j : j + n], where=less)
        np.copyto(at, np.arange(j, j + n), where=less)
    marked = np.zeros(len(r), dtype=bool)
    marked[at] = True
    return np.flatnonzero(marked)


def units_of(text: bytes, least: int = LEAST, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """h1, h2, first word, words, start, end of each unit; offsets count characters."""
    h, start, end = words_of(text)
    b = cuts(h, window) if len(h) >= least else np.zeros(0, dtype=np.int64)
    to = np.searchsorted(b, b + least - 2)
    whole = to < len(b)
    first, after = b[whole], b[to[whole]] + 2  # with both words of the pair
    lead = np.zeros(len(text) + 1, dtype=np.int32)
    if len(first):
        np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80, out=lead[1:])
    h1, h2 = stretch_hashes(h, first, after), stretch_hashes(mix(h ^ M2), first, after)
    return h1.view(np.int64), h2.view(np.int64), first, after - first, lead[start[first]], lead[end[after - 1]]


def _units(least: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, null, tx = int64s(b["doc_id"]), b["doc_id"].is_null().to_numpy(zero_copy_only=False), int64s(b["tx"])
            held, owner, size = [], [], 0

            def made() -> pa.RecordBatch:
                h1, h2, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
                at = np.repeat(owner, [len(x[0]) for x in held])
                return pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), nullable(ids[at], null[at]), pa.array(tx[at]), *(pa.array(x.astype(np.int32)) for x in rest)], schema=UNITS)

            for i, text in enumerate(raw_texts(b["text"])):
                own = units_of(text or b"", least, window)
                if len(own[0]):
                    held.append(own)
                    owner.append(i)
                    size += len(own[0])
                if size > 200_000:
                    yield made()
                    held, owner, size = [], [], 0
            if held:
                yield made()

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by digest and rank: what isn't the first occurrence of its digest in this partition, with that first; and as edges the first rows of the partition's first and last digest."""

    def report(rows: pa.RecordBatch, doc, null, tx, edge: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, nullable(doc, null), pa.array(tx), pa.array(np.full(len(rows), edge))], schema=FOUND)

    key = first = head = None
    for b in batches:
        if not len(b):
            continue
        h1, h2, tx, k = int64s(b["h1"]), int64s(b["h2"]), int64s(b["tx"]), int64s(b["k"])
        doc, null = int64s(b["doc_id"]), b["doc_id"].is_null().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        lengths = np.diff(np.r_[starts, len(b)])
        fd, fn, ft, fk = doc[starts], null[starts], tx[starts], k[starts]
        if key == (h1[0], h2[0]):
            fd[0], fn[0], ft[0], fk[0] = first[1:]
        if key != (h1[0], h2[0]) or len(starts) > 1:
            at = starts[-1]
            first = (b.slice(at, 1), doc[at], null[at], tx[at], k[at])
        if head is None:
            yield report(b.slice(0, 1), doc[:1], null[:1], tx[:1], True)
            head = (int(h1[0]), int(h2[0]))
        key = (int(h1[-1]), int(h2[-1]))
        fd, fn, ft, fk = (np.repeat(x, lengths) for x in (fd, fn, ft, fk))
        # An exactly repeated row is the same occurrence.
        later = (doc != fd) | (null != fn) | (tx != ft) | (k != fk)
        if later.any():
            yield report(b.filter(pa.array(later)), fd[later], fn[later], ft[later], False)
    if key is not None and key != head:
        row, doc, null, tx, _ = first
        yield report(row, np.array([doc]), np.array([null]), np.array([tx]), True)


def _settled(shared: list[tuple]):
    """What is later in its partition is so everywhere, but with the first of all; a partition's own first is later if another partition has an earlier one."""
    firsts = {(h1, h2): (doc, tx, k) for h1, h2, doc, tx, k in shared}
    known = np.unique(np.array([h1 for h1, *_ in shared], dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2, tx, k = int64s(b["h1"]), int64s(b["h2"]), int64s(b["tx"]), int64s(b["k"])
            doc, null = int64s(b["doc_id"]), b["doc_id"].is_null().to_numpy(zero_copy_only=False)
            fd, fn, ft = int64s(b["first_doc"]).copy(), b["first_doc"].is_null().to_numpy(zero_copy_only=False).copy(), int64s(b["first_tx"]).copy()
            keep = ~b["edge"].to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.isin(h1, known))
            if len(at):
                pairs, group = np.unique(np.stack([h1[at], h2[at]], axis=1), axis=0, return_inverse=True)
                for g, pair in enumerate(map(tuple, pairs.tolist())):
                    if pair in firsts:
                        own, (d, t, place) = at[group.ravel() == g], firsts[pair]
                        fd[own], fn[own], ft[own] = d or 0, d is None, t
                        keep[own] |= (doc[own] != (d or 0)) | (null[own] != (d is None)) | (tx[own] != t) | (k[own] != place)
            keep &= (doc != fd) | (null != fn) | (tx != ft)  # a document's own repeats stay
            mask = pa.array(keep)
            out = [b[c].filter(mask) for c in ("doc_id", "tx", "k", "words", "start", "end")]
            yield pa.RecordBatch.from_arrays([*out, nullable(fd[keep], fn[keep])], names=["doc_id", "tx", "k", "words", "start", "end", "first_doc"])

    return run


def _known(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tx"))


def repeated_passages(docs: DataFrame, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """doc_id, tx, start, end, words, first_doc_ids (the documents that keep its units) of every span that goes."""
    n = partitions(docs.sparkSession)
    # Made twice, for the sample that gives the ranges and for the rows: cheaper on disk than a table of all units.
    units = _known(docs).mapInArrow(_units(least, window), UNITS_DDL)
    ranked = units.repartitionByRange(n, "h1", "h2", *RANK).sortWithinPartitions("h1", "h2", *RANK)
    found = stage(ranked.mapInArrow(_later, FOUND_DDL), "found")
    # Two rows a partition at most. Null ids come first in rank, as in the sort.
    edges = found.where("edge").groupBy("h1", "h2").agg(F.min(F.struct(*RANK)).alias("f"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "f.*")
    rows = found.mapInArrow(_settled([tuple(r) for r in edges.collect()]), "doc_id long, tx long, k int, words int, start int, end int, first_doc long")
    # One row a document: as long as its own units.
    per = rows.groupBy("doc_id", "tx").agg(F.collect_list(F.struct("k", "words", "start", "end", "first_doc")).alias("units"))
    return per.mapInArrow(_joined, SPANS_DDL)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units that overlap or touch, as one span."""
    for b in batches:
        out = []
        for doc, tx, units in zip(b["doc_id"].to_pylist(), b["tx"].to_pylist(), b["units"], strict=True):
            k, words, start, end = (int64s(units.values.field(c)) for c in ("k", "words", "start", "end"))
            order = np.argsort(k, kind="stable")
            k, start, first = k[order], start[order], units.values.field("first_doc").take(pa.array(order))
            reach, ends = np.maximum.accumulate(k + words[order]), np.maximum.accumulate(end[order])
            heads = [0, *(np.flatnonzero(k[1:] > reach[:-1]) + 1).tolist(), len(k)]
            for lo, hi in zip(heads, heads[1:], strict=False):
                firsts = sorted(first[lo:hi].unique().to_pylist(), key=lambda d: (d is not None, d or 0))
                out.append((doc, tx, int(start[lo]), int(ends[hi - 1]), int(reach[hi - 1] - k[lo]), firsts))
        doc, tx, start, end, words, firsts = zip(*out, strict=True) if out else [()] * 6
        columns = [pa.array(doc, pa.int64()), pa.array(tx, pa.int64()), *(pa.array(x, pa.int32()) for x in (start, end, words)), pa.array(firsts, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tx", "start", "end", "words", "first_doc_ids"])


def _cut(docs: DataFrame, spans: DataFrame, how: str) -> tuple[DataFrame, Column]:
    """(docs with their spans as _tq_s, what is left of text)."""
    per = spans.groupBy(F.col("doc_id").alias("_tq_d"), F.col("tx").alias("_tq_t")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "words", "first_doc_ids"))).alias("_tq_s"))
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("_tq_d")) & (F.xxhash64(docs["text"]) == F.col("_tq_t"))
    both = docs.join(per.hint("shuffle_hash"), on, how)
    size = F.size("_tq_s")
    # What lies between the spans.
    kept = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.substring(docs["text"], F.when(i == 0, 1).otherwise(F.get("_tq_s", i - 1)["end"] + 1), F.when(i == size, F.length(docs["text"])).otherwise(F.get("_tq_s", i)["start"]) - F.when(i == 0, 0).otherwise(F.get("_tq_s", i - 1)["end"])),
    )
    return both, F.when(F.col("_tq_s").isNull(), docs["text"]).otherwise(F.array_join(kept, ""))


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs, with the removed spans cut out of text."""
    both, text = _cut(docs, spans, "left")
    return both.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every removed span, and the length and digest of what its document keeps; repeated rows have theirs each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both, text = _cut(docs, stage(repeated_passages(docs), "spans"), "inner")
    kept = both.select("doc_id", "_tq_s", text.alias("kept")).select("doc_id", "_tq_s", F.length("kept").alias("kept_chars"), F.sha2("kept", 256).alias("kept_sha256"))
    return kept.select("doc_id", F.explode("_tq_s").alias("s"), "kept_chars", "kept_sha256").select("doc_id", "s.start", "s.end", "s.words", "s.first_doc_ids", "kept_chars", "kept_sha256")
