"""Partition functions as expressions, and the pruning of partitions by predicates.

Each function gives `shard(column)`, and the shards that `equal`, `any_of` and `between` can meet (None: all). Ranges of keys come from a list, as small as a
configuration file is.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_SLOTS = 2880
#: Fixed value: the multiplier of jump consistent hashing.
JUMP = 2862933555777941757
WRAP = 1 << 64


def number(raw: str) -> int:
    """'500M', '10K' or plain digits; K is a thousand and M ten thousand."""
    raw = raw.strip().upper()
    unit = {"K": 1000, "M": 10000}.get(raw[-1:])
    if unit is None:
        return int(raw)
    whole, _, part = raw[:-1].partition(".")
    return int(whole) * unit + (round(float("0." + part) * unit) if part else 0)


def ranges(lines: Iterable[str]) -> list[tuple[int, int, int]]:
    """(low, high, shard) of lines such as '0-500M=0' or '200M1-400M=1', where digits after a unit are added."""
    import re

    def edge(raw: str) -> int:
        m = re.fullmatch(r"(\d+(?:\.\d+)?[KM])(\d+)", raw.strip().upper())
        return number(m[1]) + int(m[2]) if m else number(raw)

    out = []
    for line in lines:
        line = line.strip()
        if line and not line.startswith(("#", "//")):
            span, _, shard = line.partition("=")
            low, _, high = span.partition("-")
            out.append((edge(low), edge(high), int(shard)))
    return out


class ShardFunction:
    """shard() as a column; of() of one value, in Python, for pruning."""

    def shard(self, c: Column) -> Column:
        raise NotImplementedError

    def of(self, value) -> int | None:
        raise NotImplementedError

    def between(self, low, high) -> set[int] | None:
        return None

    def shards(self) -> set[int]:
        """All shards that there can be; of functions without an end, none."""
        return set()

    def any_of(self, values: Iterable) -> set[int] | None:
        found = {self.of(v) for v in values}
        return None if None in found else found


def segments(counts: list[int], lengths: list[int]) -> list[int]:
    if len(counts) != len(lengths) or not counts:
        raise ValueError("counts and lengths go together")
    if sum(c * n for c, n in zip(counts, lengths, strict=True)) > MOST_SLOTS:
        raise ValueError(f"slots may not exceed {MOST_SLOTS}")
    out: list[int] = []
    for c, n in zip(counts, lengths, strict=True):
        for _ in range(c):
            out += [(out[-1] + 1 if out else 0)] * n
    return out


def slot_to_shard(slot: Column, table: list[int]) -> Column:
    """The shard of a slot, by the ends of the shards' runs."""
    ends = [i for i in range(1, len(table) + 1) if i == len(table) or table[i] != table[i - 1]]
    out = F.lit(table[-1])
    for end in reversed(ends[:-1]):
        out = F.when(slot < end, F.lit(table[end - 1])).otherwise(out)
    return out.cast("int")


@dataclass
class Hash(ShardFunction):
    """Integer keys: key modulo the number of slots; NULL is shard 0."""

    counts: list[int]
    lengths: list[int]
    table: list[int] = field(init=False)

    def __post_init__(self):
        self.table = segments(self.counts, self.lengths)

    def shard(self, c: Column) -> Column:
        slot = F.pmod(c.cast("long"), F.lit(len(self.table)).cast("long"))
        return F.when(c.isNull(), F.lit(0)).otherwise(slot_to_shard(slot, self.table))

    def shards(self) -> set[int]:
        return set(self.table)

    def of(self, value) -> int | None:
        return 0 if value is None else self.table[int(value) % len(self.table)]

    def between(self, low, high) -> set[int] | None:
        return None if high - low >= len(self.table) else {self.of(v) for v in range(low, high + 1)}


def slice_ends(size: int | Column, start: int, end: int, greatest=max, least=min) -> tuple:
    """Places of [start:end] in a text of that size; an end of 0 is the end of the text, negative places count from it."""
    at = lambda n: greatest(size + n, 0) if n < 0 else least(n, size)
    return at(start), size if end == 0 else at(end)


def _slice_ends(size: Column, start: int, end: int) -> tuple[Column, Column]:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    low, high = slice_ends(size, start, end, lambda a, b: F.greatest(col(a), col(b)), lambda a, b: F.least(col(a), col(b)))
    return low, F.greatest(high - low, F.lit(0))


def units(s: str) -> list[int]:
    """The 16-bit units of a text, in which places are counted and hashes made."""
    raw = s.encode("utf-16-be", "surrogatepass")
    return [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw), 2)]


def sliced_hash(s: str, start: int, end: int) -> int:
    own = units(s)
    low, high = slice_ends(len(own), start, end)
    h = 0
    for u in own[low:high]:
        h = (31 * h + u) % WRAP
    return h - WRAP if h >= WRAP >> 1 else h


def text_hash(s: Column, start: int = 0, end: int = 0) -> Column:
    """31 * h + unit over the 16-bit units of s[start:end], wrapped to 64 bits with sign: in halves of 32 bits, which can't overflow."""
    low = F.lit((1 << 32) - 1).cast("long")

    def fold(codes: Column) -> Column:
        def step(h: Column, code: Column) -> Column:
            right = h.bitwiseAND(low) * 31 + code
            left = (F.shiftrightunsigned(h, 32) * 31 + F.shiftright(right, 32)).bitwiseAND(low)
            return F.shiftleft(left, 32).bitwiseOR(right.bitwiseAND(low))

        return F.aggregate(codes, F.lit(0).cast("long"), step)

    at, size = _slice_ends(F.char_length(s), start, end)
    letters = F.filter(F.split(F.substring(s, at + 1, size), ""), lambda ch: ch != "")
    # Characters beyond 16 bits are two units each.
    raw = F.hex(F.encode(s, "UTF-16BE"))
    first, count = _slice_ends((F.length(raw) / 4).cast("int"), start, end)
    wide = F.transform(F.sequence(first, first + count - 1), lambda i: F.conv(F.substring(raw, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    wide = F.when(count > 0, wide).otherwise(F.array().cast("array<long>"))
    return F.when(s.rlike("[\\x{10000}-\\x{10FFFF}]"), fold(wide)).otherwise(fold(F.transform(letters, lambda ch: F.ascii(ch).cast("long"))))


@dataclass
class StringHash(ShardFunction):
    """Texts: a hash of a slice, modulo the number of slots; NULL is shard 0."""

    counts: list[int]
    lengths: list[int]
    start: int = 0
    end: int = 0
    table: list[int] = field(init=False)

    def __post_init__(self):
        self.table = segments(self.counts, self.lengths)

    def shard(self, c: Column) -> Column:
        slot = F.pmod(text_hash(c.cast("string"), self.start, self.end), F.lit(len(self.table)).cast("long"))
        return F.when(c.isNull(), F.lit(0)).otherwise(slot_to_shard(slot, self.table))

    def shards(self) -> set[int]:
        return set(self.table)

    def of(self, value) -> int | None:
        return 0 if value is None else self.table[sliced_hash(str(value), self.start, self.end) % len(self.table)]


@dataclass
class NumberRange(ShardFunction):
    """Inclusive ranges of numbers; the default for the rest, else NULL."""

    spans: list[tuple[int, int, int]]
    default: int | None = None

    def shard(self, c: Column) -> Column:
        out = F.lit(self.default).cast("int")
        for low, high, shard in reversed(self.spans):
            out = F.when(c.between(low, high), F.lit(shard)).otherwise(out)
        return out

    def shards(self) -> set[int]:
        return {s for _, _, s in self.spans} | ({self.default} - {None})

    def of(self, value) -> int | None:
        return next((s for low, high, s in self.spans if value is not None and low <= int(value) <= high), self.default)

    def between(self, low, high) -> set[int] | None:
        met = sorted((max(a, low), min(b, high), s) for a, b, s in self.spans if a <= high and low <= b)
        if low > high:
            return set()
        # A key that no span has goes to the default; without one it has no shard.
        at = low
        for a, b, _ in met:
            if a > at:
                break
            at = max(at, b + 1)
        found = {s for _, _, s in met}
        return found if at > high else None if self.default is None else found | {self.default}


@dataclass
class Enumeration(ShardFunction):
    """Exact values."""

    values: dict
    default: int | None = None

    def shard(self, c: Column) -> Column:
        pairs = [x for k, v in self.values.items() for x in (F.lit(k), F.lit(v))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(self.default).cast("int"))

    def shards(self) -> set[int]:
        return set(self.values.values()) | ({self.default} - {None})

    def of(self, value) -> int | None:
        return self.values.get(value, self.default)


@dataclass
class DateRange(ShardFunction):
    """Spans of `days` from `begin`; with an end, later dates wrap round; earlier ones take the default."""

    begin: datetime.date
    days: int
    end: datetime.date | None = None
    default: int | None = None

    def __post_init__(self):
        self.count = None if self.end is None else (self.end - self.begin).days // self.days + 1

    def shard(self, c: Column) -> Column:
        at = F.floor(F.datediff(c, F.lit(self.begin)) / self.days)
        at = at if self.count is None else F.pmod(at, F.lit(self.count).cast("long"))
        return F.when(c >= F.lit(self.begin), at.cast("int")).otherwise(F.lit(self.default).cast("int"))

    def shards(self) -> set[int]:
        return set(range(self.count or 0)) | ({self.default} - {None})

    def of(self, value) -> int | None:
        if value is None or value < self.begin:
            return self.default
        at = (value - self.begin).days // self.days
        return at if self.count is None else at % self.count

    def between(self, low, high) -> set[int] | None:
        if low > high:
            return set()
        if low < self.begin and self.default is None:
            return None
        early = {self.default} if low < self.begin else set()
        if high < self.begin:
            return early
        first, last = (max((d - self.begin).days, 0) // self.days for d in (low, high))
        if self.count is None:
            return early | set(range(first, last + 1))
        return early | {i % self.count for i in range(first, min(last, first + self.count - 1) + 1)}


@dataclass
class Pattern(ShardFunction):
    """The number modulo a value, then ranges; the default for what isn't a number."""

    modulus: int
    spans: list[tuple[int, int, int]]
    default: int | None = None

    def shard(self, c: Column) -> Column:
        n = c.cast("string").try_cast("long")
        return F.when(n.isNull(), F.lit(self.default).cast("int")).otherwise(NumberRange(self.spans, self.default).shard(F.pmod(n, F.lit(self.modulus).cast("long"))))

    def shards(self) -> set[int]:
        return {s for _, _, s in self.spans} | ({self.default} - {None})

    def of(self, value) -> int | None:
        try:
            return NumberRange(self.spans, self.default).of(int(value) % self.modulus)
        except (TypeError, ValueError):
            return self.default

    def between(self, low, high) -> set[int] | None:
        """None, all shards, also where an end isn't a number."""
        try:
            low, high = int(low), int(high)
        except (TypeError, ValueError):
            return None
        if low > high:
            return set()
        if high - low >= self.modulus:
            return None
        first, last = low % self.modulus, high % self.modulus
        ends = [(first, last)] if first <= last else [(first, self.modulus - 1), (0, last)]
        return disjunction(*(NumberRange(self.spans, self.default).between(a, b) for a, b in ends))


@dataclass
class JumpHash(ShardFunction):
    """Jump consistent hashing of a text's slice: batches of keys at once, as its loop has no closed form."""

    buckets: int
    start: int = 0
    end: int = 0

    def shard(self, c: Column) -> Column:
        buckets = self.buckets

        @F.pandas_udf("int")
        def jump(keys: pd.Series) -> pd.Series:
            known = keys.fillna(0).map(int)
            return pd.Series(jump_buckets(np.array([k % WRAP for k in known], dtype=np.uint64), buckets)).astype("int32")

        return F.when(c.isNull(), F.lit(0)).otherwise(jump(text_hash(c.cast("string"), self.start, self.end)))

    def shards(self) -> set[int]:
        return set(range(self.buckets))

    def of(self, value) -> int | None:
        key = sliced_hash(str(value), self.start, self.end) if value is not None else None
        return 0 if key is None else int(jump_buckets(np.array([key % WRAP], dtype=np.uint64), self.buckets)[0])


def jump_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Each round moves the keys whose next bucket is still inside."""
    last, ahead = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    keys = keys.copy()
    going = np.ones(len(keys), dtype=bool)
    while going.any():
        last[going] = ahead[going]
        keys[going] = keys[going] * np.uint64(JUMP) + np.uint64(1)
        ahead[going] = ((last[going] + 1) * (float(1 << 31) / ((keys[going] >> np.uint64(33)).astype(float) + 1.0))).astype(np.int64)
        going &= ahead < buckets
    return last


@dataclass
class ShardedTable:
    """A table with its partition function: `shard_id` as a column, and reads that meet only some shards."""

    df: DataFrame
    column: str
    function: ShardFunction

    def with_shards(self) -> DataFrame:
        return self.df.withColumn("shard_id", self.function.shard(F.col(self.column)))

    def distribution(self) -> DataFrame:
        return self.with_shards().groupBy("shard_id").agg(F.count("*").alias("n_rows"))

    def prune(self, shards: set[int] | None) -> DataFrame:
        """For a table laid out by shard_id, the filter selects directories."""
        rows = self.df if "shard_id" in self.df.columns else self.with_shards()
        return rows if shards is None else rows.where(F.col("shard_id").isin(sorted(shards)))

    def where_equal(self, value) -> DataFrame:
        return self.prune(self.function.any_of([value])).where(F.col(self.column).eqNullSafe(F.lit(value)))

    def where_in(self, values: list) -> DataFrame:
        return self.prune(self.function.any_of(values)).where(F.col(self.column).isin(values))

    def where_between(self, low, high) -> DataFrame:
        return self.prune(self.function.between(low, high)).where(F.col(self.column).between(low, high))

    def write(self, path: str) -> None:
        """One directory a shard; each task writes the shards it has, so no shard is gathered in one task."""
        self.with_shards().write.partitionBy("shard_id").parquet(path)


def conjunction(*units: set[int] | None) -> set[int] | None:
    """Shards of ANDed conditions."""
    known = [u for u in units if u is not None]
    return set.intersection(*known) if known else None


def disjunction(*units: set[int] | None) -> set[int] | None:
    """Shards of ORed conditions."""
    return None if any(u is None for u in units) else set().union(*units)


def consistency(copies: dict[str, DataFrame]) -> DataFrame:
    """copy, n_rows, checksum of each copy of a global table; equal copies agree in both."""
    out = None
    for name, df in copies.items():
        row = df.select(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("checksum")).select(F.lit(name).alias("copy"), "n_rows", "checksum")
        out = row if out is None else out.unionByName(row)
    return out
