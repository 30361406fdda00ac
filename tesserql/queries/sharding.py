"""Partition functions, distribution, pruning and consistency."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import sharding as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HASH = S.Hash([2, 1], [256, 512])
TEXT = S.StringHash([4], [256], 0, 0)
RANGE = S.NumberRange(S.ranges(["0-499=0", "500-9K=1", "9K1-2M=2"]), default=3)
ENUM = S.Enumeration({"AUTOMOBILE": 0, "BUILDING": 1, "MACHINERY": 2}, default=3)
DATES = S.DateRange(datetime.date(1995, 1, 1), 100, datetime.date(1997, 12, 31), default=0)
PATTERN = S.Pattern(256, S.ranges(["0-63=0", "64-127=1", "128-191=2", "192-255=3"]), default=1)
JUMP = S.JumpHash(5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(name: str, of: str, key: str, column: str, function: S.ShardFunction, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir, of).select(key, function.shard(F.col(column)).cast("long").alias("shard"))
    if sql:
        ORACLE_SQL[name] = f"SELECT {key}, CAST({sql} AS BIGINT) AS shard FROM {of}"


_hash = "CASE WHEN o_custkey % 1024 < 256 THEN 0 WHEN o_custkey % 1024 < 512 THEN 1 ELSE 2 END"
_fold = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 18446744073709551616)"
_date = "CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 0 ELSE (date_diff('day', DATE '1995-01-01', o_orderdate) // 100) % 11 END"
_range = "CASE WHEN o_custkey <= 499 THEN 0 WHEN o_custkey <= 9000 THEN 1 WHEN o_custkey <= 20000 THEN 2 ELSE 3 END"
shards("shard_hash", "orders", "o_orderkey", "o_custkey", HASH, _hash)
shards("shard_string_hash", "customer", "c_custkey", "c_name", TEXT, f"({_fold} % 1024) // 256")
shards("shard_range", "orders", "o_orderkey", "o_custkey", RANGE, _range)
shards("shard_enum", "customer", "c_custkey", "c_mktsegment", ENUM, "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END")
shards("shard_date", "orders", "o_orderkey", "o_orderdate", DATES, _date)
shards("shard_pattern", "orders", "o_orderkey", "o_custkey", PATTERN, "(o_custkey % 256) // 64")
shards("shard_jump", "customer", "c_custkey", "c_custkey", JUMP, None)
#: The jumps of all keys, step by step.
ORACLE_SQL["shard_jump"] = f"""
WITH RECURSIVE h AS (SELECT c_custkey, {_fold.replace("c_name", "c_custkey::VARCHAR")} AS k FROM customer),
j AS (
  SELECT c_custkey, k, -1::BIGINT AS b, 0::BIGINT AS n FROM h
  UNION ALL
  SELECT c_custkey, k2, n, floor((n + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1.0)))::BIGINT
  FROM (SELECT c_custkey, n, (k * {S.JUMP}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM j WHERE n < 5))
SELECT c_custkey, max(b)::BIGINT AS shard FROM j GROUP BY c_custkey
"""


def orders(spark: SparkSession, sf_dir: str, function: S.ShardFunction = HASH, column: str = "o_custkey") -> S.ShardedTable:
    return S.ShardedTable(table(spark, sf_dir, "orders"), column, function)


QUERIES["shard_distribution"] = lambda spark, sf_dir: orders(spark, sf_dir).distribution().select(F.col("shard_id").cast("long").alias("shard_id"), "n_rows")
ORACLE_SQL["shard_distribution"] = f"SELECT CAST({_hash} AS BIGINT) AS shard_id, CAST(count(*) AS BIGINT) AS n_rows FROM orders GROUP BY ALL"
QUERIES["shard_prune_equal"] = lambda spark, sf_dir: orders(spark, sf_dir).where_equal(77).select("o_orderkey", "o_custkey")
ORACLE_SQL["shard_prune_equal"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 77"
QUERIES["shard_prune_in"] = lambda spark, sf_dir: orders(spark, sf_dir).where_in([1, 600, 77]).select("o_orderkey", "o_custkey")
ORACLE_SQL["shard_prune_in"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 600, 77)"
QUERIES["shard_prune_between"] = lambda spark, sf_dir: orders(spark, sf_dir, RANGE).where_between(450, 520).select("o_orderkey", "o_custkey")
ORACLE_SQL["shard_prune_between"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 450 AND 520"


GAPS = S.NumberRange([(0, 499, 0), (800, 999, 1)], default=2)
QUERIES["shard_prune_gap"] = lambda spark, sf_dir: orders(spark, sf_dir, GAPS).where_between(450, 820).select("o_orderkey", "o_custkey")
ORACLE_SQL["shard_prune_gap"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 450 AND 820"
QUERIES["shard_prune_pattern"] = lambda spark, sf_dir: orders(spark, sf_dir, PATTERN).where_between(200, 300).select("o_orderkey", "o_custkey")
ORACLE_SQL["shard_prune_pattern"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 200 AND 300"
QUERIES["shard_prune_date"] = lambda spark, sf_dir: orders(spark, sf_dir, DATES, "o_orderdate").where_between(datetime.date(1994, 11, 1), datetime.date(1995, 8, 1)).select("o_orderkey", "o_custkey")
ORACLE_SQL["shard_prune_date"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate BETWEEN DATE '1994-11-01' AND DATE '1995-08-01'"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(custkey = 77 or custkey between 450 and 820) and custkey in (77, 600, 5000): the shards of ANDed conditions meet, those of ORed ones add up."""
    t = orders(spark, sf_dir, GAPS)
    met = S.conjunction(S.disjunction(GAPS.any_of([77]), GAPS.between(450, 820)), GAPS.any_of([77, 600, 5000]))
    return t.prune(met).where("(o_custkey = 77 OR o_custkey BETWEEN 450 AND 820) AND o_custkey IN (77, 600, 5000)").select("o_orderkey", "o_custkey")


QUERIES["shard_prune_units"] = _units
ORACLE_SQL["shard_prune_units"] = "SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey = 77 OR o_custkey BETWEEN 450 AND 820) AND o_custkey IN (77, 600, 5000)"


def global_inconsistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of which one lacks a row and one has another value: which copies agree with the first."""
    nation = table(spark, sf_dir, "nation")
    changed = nation.withColumn("n_name", F.when(F.col("n_nationkey") == 7, "OTHER").otherwise(F.col("n_name")))
    seen = S.consistency({"a": nation, "b": nation.where("n_nationkey <> 3"), "c": changed, "d": nation.orderBy(F.desc("n_name"))})
    first = seen.where("copy = 'a'").select(F.col("n_rows").alias("_n"), F.col("checksum").alias("_c"))
    return seen.crossJoin(F.broadcast(first)).select("copy", "n_rows", ((F.col("n_rows") == F.col("_n")) & (F.col("checksum") == F.col("_c"))).alias("agrees"))


QUERIES["global_inconsistency"] = global_inconsistency
ORACLE_SQL["global_inconsistency"] = "SELECT * FROM (SELECT count(*) AS n FROM nation) CROSS JOIN (VALUES ('a', 0, TRUE), ('b', 1, FALSE), ('c', 0, FALSE), ('d', 0, TRUE)) v(copy, less, agrees)"
ORACLE_SQL["global_inconsistency"] = f"SELECT copy, CAST(n - less AS BIGINT) AS n_rows, agrees FROM ({ORACLE_SQL['global_inconsistency']})"


def global_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two copies of a global table, the second dealt anew: the same counts and checksums."""
    nation = table(spark, sf_dir, "nation")
    seen = S.consistency({"a": nation, "b": nation.repartition(4)})
    return seen.agg(F.count("*").alias("copies"), F.max("n_rows").alias("n_rows"), (F.count_distinct("n_rows", "checksum") == 1).alias("consistent"))


QUERIES["global_consistency"] = global_consistency
ORACLE_SQL["global_consistency"] = "SELECT CAST(2 AS BIGINT) AS copies, CAST(count(*) AS BIGINT) AS n_rows, TRUE AS consistent FROM nation"
