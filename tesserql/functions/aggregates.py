"""Aggregates with MySQL's results for empty groups and NULLs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Value, col, cols, text
from .maths import U64, UNSIGNED, unsigned

ALL_BITS = UNSIGNED - 1
GROUP_CONCAT_MAX_LEN = 1024


def count(*xs: Value) -> Column:
    """COUNT(*), or rows where no argument is NULL."""
    if not xs:
        return F.count(F.lit(1))
    known = col(xs[0]).isNotNull()
    for x in xs[1:]:
        known = known & col(x).isNotNull()
    return F.count(F.when(known, F.lit(1)))


def count_distinct(*xs: Value) -> Column:
    return F.count_distinct(*cols(xs))


def sum_(x: Value, distinct: bool = False) -> Column:
    return F.sum_distinct(col(x)) if distinct else F.sum(col(x))


def avg(x: Value, distinct: bool = False) -> Column:
    if not distinct:
        return F.avg(col(x))
    return F.sum_distinct(col(x)).cast("double") / F.when(F.count_distinct(col(x)) > 0, F.count_distinct(col(x)))


def min_(x: Value) -> Column:
    return F.min(col(x))


def max_(x: Value) -> Column:
    return F.max(col(x))


def std(x: Value) -> Column:
    return F.stddev_pop(col(x))


stddev = stddev_pop = std


def stddev_samp(x: Value) -> Column:
    return F.stddev_samp(col(x))


def variance(x: Value) -> Column:
    return F.var_pop(col(x))


var_pop = variance


def var_samp(x: Value) -> Column:
    return F.var_samp(col(x))


def bit_and(x: Value) -> Column:
    """All 64 bits for an empty group."""
    return F.coalesce(unsigned(F.bit_and(col(x).cast("long"))), F.lit(Decimal(ALL_BITS)).cast(U64))


def bit_or(x: Value) -> Column:
    return F.coalesce(unsigned(F.bit_or(col(x).cast("long"))), F.lit(0).cast(U64))


def bit_xor(x: Value) -> Column:
    return F.coalesce(unsigned(F.bit_xor(col(x).cast("long"))), F.lit(0).cast(U64))


def any_value(x: Value) -> Column:
    """A value of some row of the group: what a column outside GROUP BY stands for."""
    return F.any_value(col(x))


def group_concat(*xs: Value, order: list[tuple[Value, bool]] = (), distinct: bool = False, separator: str = ",", max_len: int = GROUP_CONCAT_MAX_LEN) -> Column:
    """GROUP_CONCAT([DISTINCT] xs ORDER BY order SEPARATOR separator), cut at max_len; rows with a NULL argument don't count, NULL for none.

    order: (key, ascending) pairs; keys of descending order must be numbers. DISTINCT without an order sorts by the text.
    """
    value = F.concat(*[text(x) for x in xs])
    keys = [col(k) if up else -col(k) for k, up in order]
    entry = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], value.alias("v"))
    kept = F.when(value.isNotNull(), entry)
    rows = F.collect_set(kept) if distinct else F.collect_list(kept)
    rows = F.sort_array(rows) if keys or distinct else rows
    joined = F.array_join(F.transform(rows, lambda r: r["v"]), separator)
    return F.when(F.size(rows) > 0, F.left(joined, F.lit(max_len)))
