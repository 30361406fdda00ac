"""Joins: MySQL's forms, and the choice between broadcasting, co-located and shuffled joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a global table is sent to every executor.
BROADCAST_BYTES = 64 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A global table by broadcast where its estimated size allows, else as it is: then the join shuffles."""
    return F.broadcast(df) if plan_bytes(df) <= most else df


def inner(a: DataFrame, b: DataFrame, on: Column | list[str] | None = None) -> DataFrame:
    """JOIN, comma, CROSS JOIN and STRAIGHT_JOIN: without a condition, all pairs."""
    return a.crossJoin(b) if on is None else a.join(b, on, "inner")


def outer(a: DataFrame, b: DataFrame, on: Column | list[str], side: str = "left") -> DataFrame:
    """LEFT or RIGHT JOIN; these have a condition."""
    if on is None or side not in ("left", "right"):
        raise ValueError("an outer join is LEFT or RIGHT and has a condition")
    return a.join(b, on, side)


def natural(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """NATURAL JOIN: equal names join, and come once and first."""
    names = [c for c in a.columns if c in b.columns]
    return a.join(b, names, how) if names else a.crossJoin(b)


def global_join(a: DataFrame, table: DataFrame, on: Column | list[str], how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """A join with a table that every node has a copy of."""
    return a.join(broadcast_if_small(table, most), on, how)


def semi(a: DataFrame, b: DataFrame, on: Column | list[str]) -> DataFrame:
    """IN or EXISTS."""
    return a.join(b, on, "left_semi")


def anti(a: DataFrame, b: DataFrame, on: Column | list[str]) -> DataFrame:
    """NOT EXISTS: rows without an equal key; a NULL key has none."""
    return a.join(b, on, "left_anti")


def reduced(big: DataFrame, small: DataFrame, key: str, small_key: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """A filtered small side joins a big one: its distinct keys first reduce the big side, by broadcast if they are few enough."""
    keys = small.select(F.col(small_key).alias("_k")).distinct()
    few = big.join(broadcast_if_small(keys, most), F.col(key) == F.col("_k"), "left_semi")
    return few.join(small, F.col(key) == F.col(small_key), "inner")


def salted(a: DataFrame, b: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """An equi-join for hot keys of a: its rows are dealt over `salts`, b's rows are repeated for each."""
    left = a.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in a.columns]), F.lit(salts)).cast("int"))
    right = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def write_co_located(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> None:
    """A table bucketed and sorted by its key, in the warehouse or at a path: tables alike in both join, and group by the key, without a shuffle."""
    writer = df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def hinted(order: list[tuple[DataFrame, str | None]], ons: list[Column]) -> DataFrame:
    """Tables joined in the order given, each with its strategy hint (broadcast, merge, shuffle_hash) or None."""
    out, _ = order[0]
    for (df, hint), on in zip(order[1:], ons, strict=True):
        out = out.join(df.hint(hint) if hint else df, on)
    return out
