"""INSERT, REPLACE, UPDATE and DELETE as rewrites: each returns the table's next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update(df: DataFrame, where: Column, shard_column: str | None = None, **values: Column) -> DataFrame:
    """Assignments see the row as it was; the sharding column may not change."""
    if shard_column in values:
        raise ValueError(f"the sharding column {shard_column} can't be updated")
    hit = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns])


def update_join(df: DataFrame, source: DataFrame, on: dict[str, str], **values: Column) -> DataFrame:
    """UPDATE with a second table, df's columns equal to source's. Each row is updated once: of source rows with one key, the least counts."""
    keys = list(on.values())
    rest = [c for c in source.columns if c not in keys]
    one = source.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_rest")).select(*keys, "_rest.*") if rest else source.select(*keys).distinct()
    hit = one.withColumn("_hit", F.lit(True))
    same = [df[a] == hit[b] for a, b in on.items()]
    out = df.join(hit, same, "left")
    return out.select(*[F.when(F.col("_hit"), values[c]).otherwise(df[c]).cast(df.schema[c].dataType).alias(c) if c in values else df[c] for c in df.columns])


def delete(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is NULL stay."""
    return df.where(~F.coalesce(where, F.lit(False)))


def delete_join(df: DataFrame, source: DataFrame, on: Column) -> DataFrame:
    return df.join(source, on, "left_anti")


def insert(df: DataFrame, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """INSERT ... SELECT or VALUES, by position over `columns`; the others are NULL."""
    columns = columns or df.columns
    if len(rows.columns) != len(columns):
        raise ValueError("as many values as columns")
    named = rows.toDF(*columns)
    return df.unionByName(named.select(*[(F.col(c) if c in columns else F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in df.columns]))


def replace(df: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """REPLACE: rows of df with a new row's key go first."""
    return insert(df.join(rows.select(*key), key, "left_anti"), rows.select(*df.columns))
