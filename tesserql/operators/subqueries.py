"""Quantified comparisons with sub-queries, and NOT IN, in three-valued logic.

A sub-query's one column is reduced to its extremes and counts, one row, which meets the outer rows by a broadcast of that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("=", "<>", "<", "<=", ">", ">=")


def _facts(values: DataFrame, column: str) -> DataFrame:
    v = F.col(column)
    return values.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(F.lit(1)).alias("_n"), F.count(v).alias("_known"))


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def quantified(df: DataFrame, x: Column, op: str, quantifier: str, values: DataFrame, column: str) -> DataFrame:
    """Rows of df for which `x op ANY | ALL (values)` is true. Over no values ANY is false and ALL is true; an unknown value keeps ALL from being true."""
    if op not in OPERATORS or quantifier not in ("ANY", "ALL"):
        raise ValueError(f"{op} {quantifier}")
    if (op, quantifier) == ("=", "ANY"):
        return df.join(values.select(F.col(column).alias("_v")), x == F.col("_v"), "left_semi")
    if (op, quantifier) == ("<>", "ALL"):
        return not_in(df, x, values, column)
    lo, hi, n, known = (F.col(c) for c in ("_lo", "_hi", "_n", "_known"))
    if quantifier == "ANY":
        edge = {"<": x < hi, "<=": x <= hi, ">": x > lo, ">=": x >= lo, "<>": (x != lo) | (x != hi)}[op]
        true = F.coalesce(edge, F.lit(False)) & (known > 0)
    else:
        edge = {"<": x < lo, "<=": x <= lo, ">": x > hi, ">=": x >= hi, "=": (x == lo) & (x == hi)}[op]
        true = (n == 0) | (F.coalesce(edge, F.lit(False)) & (n == known))
    return df.crossJoin(F.broadcast(_facts(values, column))).where(true).select(*df.columns)


def not_in(df: DataFrame, x: Column, values: DataFrame, column: str) -> DataFrame:
    """NOT IN: nothing where a value is NULL; a NULL x passes only over no values."""
    facts = F.broadcast(_facts(values, column))
    passed = df.crossJoin(facts).where((F.col("_n") == 0) | (x.isNotNull() & (F.col("_n") == F.col("_known")))).select(*df.columns)
    return passed.join(values.select(F.col(column).alias("_v")).distinct(), x == F.col("_v"), "left_anti")


def scalar(values: DataFrame, column: str):
    """A scalar sub-query's value: NULL for no row, an error for more than one."""
    rows = values.select(column).limit(2).collect()
    if len(rows) > 1:
        raise ValueError("a scalar sub-query returned more than one row")
    return rows[0][0] if rows else None
