"""Best-fit packing of tokenised documents into sequences of CAPACITY tokens by exact-complement hashing.

Lengths are counted, not listed: the plan is made from a histogram of at most CAPACITY lengths, whatever the
number of documents. From the longest length down, the gap that it leaves is looked up in an index of
available single lengths, then of pair sums, then of triple sums (see `plan` for how far); a combination that fills the gap exactly is
consumed as often as its counts allow. What is left goes by best fit, longest first, into the smallest gap
that takes it. Each row of the plan (a pattern of lengths and how many sequences have it) turns into ranges of
ranks within a length, and each piece finds its sequence and offset by its rank; ranks come from counts per
partition and length, so no length is gathered in one task.

Defined results: a null or empty text is one piece of length 1 (id 0); each row is a document, repeated rows and null ids
included; an empty table gives an empty result; further columns are ignored by `pack`.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, raw_texts, stage, table

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
END = bytes(4)


class Encoder:
    """Token ids of the byte-level BPE, as little-endian unsigned 32-bit bytes.

    The ids are those of the `tokenizers` file; they are made by `tiktoken` from the same merges, which takes a fraction of the
    time. A text with a special token's string goes to `tokenizers` itself. A text without runs of white
    space can't meet the pattern's look-ahead, so an equal pattern without it is used there.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        lines = open(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), "rb").read().splitlines()
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, lines))}
        plain = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
        make = lambda pattern: tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.full, self.plain = make(public_tokenizers.PATTERN), make(plain)
        self.path, self.own = public_tokenizers.path(vocabulary), None
        self.runs = re.compile(r"\s\s")

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            if self.own is None:
                from tokenizers import Tokenizer

                self.own = Tokenizer.from_file(self.path)
            return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        which = self.full if self.runs.search(text) else self.plain
        return np.array(which.encode_ordinary(text), dtype="<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One per Python worker."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of `capacity`, after a shorter first one where there is a rest."""
    rest = length % capacity
    return ([(0, rest)] if rest else []) + [(at, capacity) for at in range(rest, length, capacity)]


PIECES = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("nth", pa.int64())])


def _cut(vocabulary: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ids_of, seen = TaskContext.get().partitionId(), encoder(vocabulary), Counter()
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"].to_pylist(), raw_texts(b["text"]), strict=True):
                ids = ids_of((text or b"").decode("utf-8", "replace")) + END
                for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), seen[length]))
                    seen[length] += 1
            doc, k, start, length, crc, nth = zip(*rows, strict=True) if rows else [()] * 6
            yield batch(PIECES, pa.array([part] * len(rows), pa.int32()), list(doc), pa.array(k, pa.int32()), list(start), list(length), list(crc), list(nth))

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[int, list[tuple[tuple[int, ...], int]]]:
    """(depth of the index, [(lengths, number of sequences)]): exact complements first, then best fit of what is left.

    Complements of up to three lengths spend small lengths that best fit could use better, or not, as the counts have it: of the plans whose index holds
    single lengths (depth 1), also pairs (2), and also triples (3), the one with the fewest sequences is taken, the deepest of equal ones.
    """
    return min(((depth, _plan(counts, capacity, depth)) for depth in (3, 2, 1)), key=lambda p: sum(m for _, m in p[1]))


def _plan(counts: dict[int, int], capacity: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    have = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        have[n] = c
    out: list[tuple[tuple[int, ...], int]] = []
    for large in range(capacity, 0, -1):
        while have[large] and (found := complement(have, large, capacity - large, depth)):
            need = Counter(found)
            m = min(int(have[n]) // k for n, k in need.items())
            out.append((tuple(sorted(found, reverse=True)), m))
            for n, k in need.items():
                have[n] -= k * m
    return out + best_fit({n: int(c) for n, c in enumerate(have) if c}, capacity)


def complement(have: np.ndarray, large: int, gap: int, depth: int = 3) -> tuple[int, ...] | None:
    """`large` and at most `depth` lengths that fill its gap exactly, the longest first; None where the counts allow none."""
    if not gap:
        return (large,)
    ok = lambda lengths: all(have[n] >= k for n, k in Counter(lengths).items())
    if gap < len(have) and have[gap] and ok((large, gap)):
        return large, gap
    if depth < 2:
        return None
    there = have > 0
    # Pair sums: b and gap - b, both available.
    for b in np.flatnonzero(there[1:gap] & there[gap - 1 : 0 : -1])[::-1] + 1:
        if 2 * b >= gap and ok((large, int(b), gap - int(b))):
            return large, int(b), gap - int(b)
    # Triple sums: c, then the pair sums of what is left.
    for c in np.flatnonzero(there[1:gap])[::-1] + 1 if depth > 2 else ():
        rest = gap - int(c)
        if rest < 2:
            continue
        if 3 * c < gap:
            break
        for b in np.flatnonzero(there[1:rest] & there[rest - 1 : 0 : -1])[::-1] + 1:
            if c >= b >= rest - b and ok((large, int(c), int(b), rest - int(b))):
                return large, int(c), int(b), rest - int(b)
    return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: equal open sequences are one group."""
    gaps: list[int] = []  # sorted gaps that open groups have
    groups: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def put(lengths: tuple[int, ...], gap: int, m: int) -> None:
        if gap not in groups or not groups[gap]:
            bisect.insort(gaps, gap)
        groups[gap][lengths] = groups[gap].get(lengths, 0) + m

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                per = capacity // n
                if left >= per:
                    put((n,) * per, capacity - n * per, left // per)
                if left % per:
                    put((n,) * (left % per), capacity - n * (left % per), 1)
                break
            gap = gaps[at]
            lengths, m = next(iter(groups[gap].items()))
            fits = min(gap // n, left)
            used = min(m, left // fits)
            groups[gap].pop(lengths)
            if m > used:
                groups[gap][lengths] = m - used
            elif not groups[gap]:
                gaps.remove(gap)
            put(lengths + (n,) * fits, gap - n * fits, used)
            left -= fits * used
    return [(lengths, m) for gap in gaps for lengths, m in groups[gap].items()]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): each place of each pattern is a range of ranks of its length."""
    rank, sequence, out = Counter(), 0, []
    for lengths, m in patterns:
        at = 0
        for n in lengths:
            out.append((n, rank[n], m, sequence, at))
            rank[n] += m
            at += n
        sequence += m
    return out


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, and the depth of the index that the plan came from."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stage(texts.mapInArrow(_cut(vocabulary, capacity), "part int, doc_id long, piece int, start long, length long, ids_crc32 long, nth long"), "pieces")
    counted = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    totals = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    depth, patterns = plan(totals, capacity)
    found = sorted((n, first, sequence, offset) for n, first, _, sequence, offset in slots(patterns))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition of the scan
    base = counted.select(F.col("length").alias("_l"), F.col("part").alias("_p"), F.coalesce(before, F.lit(0)).alias("base"))
    # As many rows as lengths times partitions: not for a broadcast.
    ranked = pieces.join(base.hint("shuffle_hash"), (F.col("length") == F.col("_l")) & (F.col("part") == F.col("_p"))).withColumn("rank", F.col("base") + F.col("nth"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    placed = ranked.mapInArrow(_place(np.array(found, dtype=np.int64).reshape(-1, 4)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("index_depth", F.lit(depth))


PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _place(ranges: np.ndarray):
    """ranges: length, first rank, first sequence, offset, sorted; as long as the plan, which the number of lengths bounds."""
    starts = (ranges[:, 0] << 48) + ranges[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b["rank"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(starts, (b["length"].to_numpy(zero_copy_only=False) << 48) + rank, side="right") - 1
            yield batch(PLACED, *b.columns[:5], ranges[at, 2] + rank - ranges[at, 1], ranges[at, 3])

    return run


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
