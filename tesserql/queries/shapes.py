"""The statement shapes of the load drivers, on the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def scatter_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sum, count, max and min over a filter on a column that isn't the sharding column."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber = 3")
    return rows.groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count("l_orderkey").alias("n"), F.max("l_extendedprice").alias("hi"), F.min("l_extendedprice").alias("lo"))


def point_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by its key: the filter reaches the scan and its row-group statistics."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey = 4711")


QUERIES["scatter_aggregate"] = scatter_aggregate
ORACLE_SQL["scatter_aggregate"] = "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, CAST(count(l_orderkey) AS BIGINT) AS n, max(l_extendedprice) AS hi, min(l_extendedprice) AS lo FROM lineitem WHERE l_linenumber = 3 GROUP BY l_returnflag"
QUERIES["point_select"] = point_select
ORACLE_SQL["point_select"] = "SELECT * FROM orders WHERE o_orderkey = 4711"
