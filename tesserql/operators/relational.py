"""Relational operators whose MySQL form Spark lacks or spells differently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def limit(df: DataFrame, count: int, offset: int = 0) -> DataFrame:
    """LIMIT [offset,] count."""
    if count < 0 or offset < 0:
        raise ValueError("LIMIT and OFFSET may not be negative")
    return df.offset(offset).limit(count) if offset else df.limit(count)


def top(df: DataFrame, count: int, *order: Column, offset: int = 0) -> DataFrame:
    """ORDER BY ... LIMIT: a bounded heap a partition, no full sort."""
    return limit(df.orderBy(*order), count, offset)


def top_of_union(branches: list[DataFrame], count: int, *order: Column, offset: int = 0) -> DataFrame:
    """The first rows of a UNION ALL; each branch gives at most offset + count rows to the last step."""
    out = None
    for b in branches:
        part = b.orderBy(*order).limit(offset + count)
        out = part if out is None else out.union(part)
    return top(out, count, *order, offset=offset)


def union(*branches: DataFrame, distinct: bool = False) -> DataFrame:
    """UNION [ALL]: by position, names from the first branch; all branches have as many columns."""
    out = branches[0]
    for b in branches[1:]:
        if len(b.columns) != len(out.columns):
            raise ValueError("the branches of a UNION have different numbers of columns")
        out = out.union(b)
    return out.distinct() if distinct else out


def group(df: DataFrame, keys: list[Column | str], *aggregates: Column, having: Column | None = None, ordered: bool = False) -> DataFrame:
    """GROUP BY, with HAVING over the result; `ordered` sorts by the keys, as older servers do."""
    out = df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
    out = out if having is None else out.where(having)
    return out.orderBy(*out.columns[: len(keys)]) if ordered else out


def case_insensitive(c: Column) -> Column:
    """The key by which the default collation compares and groups texts."""
    return F.upper(c)


def constants(df_or_spark, **values: Column) -> DataFrame:
    """SELECT without FROM: one row."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return spark.range(1).select(*[v.alias(k) for k, v in values.items()])


def session_row(spark, user: str = "root", schema: str = "", version: str = "") -> DataFrame:
    """USER(), DATABASE(), VERSION(), LAST_INSERT_ID(), ROW_COUNT() as one row."""
    return constants(spark, user=F.lit(user), current_user=F.lit(user), database=F.lit(schema), version=F.lit(version or spark.version), last_insert_id=F.lit(0).cast("long"), row_count=F.lit(-1).cast("long"))
