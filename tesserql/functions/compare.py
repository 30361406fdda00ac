"""Comparison, control flow and logic, three-valued as in SQL; numbers are true where they aren't 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Value, all_known, col, cols, text


def eq(a: Value, b: Value) -> Column:
    return col(a) == col(b)


def ne(a: Value, b: Value) -> Column:
    return col(a) != col(b)


def gt(a: Value, b: Value) -> Column:
    return col(a) > col(b)


def ge(a: Value, b: Value) -> Column:
    return col(a) >= col(b)


def lt(a: Value, b: Value) -> Column:
    return col(a) < col(b)


def le(a: Value, b: Value) -> Column:
    return col(a) <= col(b)


def null_safe_eq(a: Value, b: Value) -> Column:
    return col(a).eqNullSafe(col(b))


def loose_eq(a: Value, b: Value) -> Column:
    """A string against a number: both as reals, a string by its numeric prefix."""
    from .casts import real

    return real(a) == real(b)


def between(x: Value, low: Value, high: Value) -> Column:
    return col(x).between(col(low), col(high))


def in_(x: Value, *items: Value) -> Column:
    """True where an item is equal, else NULL where x or an item is NULL."""
    return col(x).isin(*cols(items)) if items else F.lit(False)


def like(x: Value, pattern: str, escape: str = "\\") -> Column:
    return F.like(text(x), F.lit(pattern), F.lit(escape))


def regexp(x: Value, pattern: str) -> Column:
    return text(x).rlike(pattern)


def is_null(x: Value) -> Column:
    return col(x).isNull()


def is_not_null(x: Value) -> Column:
    return col(x).isNotNull()


def truth(x: Value) -> Column:
    return col(x).cast("double") != 0


def is_true(x: Value) -> Column:
    return F.coalesce(truth(x), F.lit(False))


def is_false(x: Value) -> Column:
    return F.coalesce(~truth(x), F.lit(False))


def is_not_true(x: Value) -> Column:
    return ~is_true(x)


def is_not_false(x: Value) -> Column:
    return ~is_false(x)


def coalesce(*xs: Value) -> Column:
    return F.coalesce(*cols(xs))


def ifnull(a: Value, b: Value) -> Column:
    return F.coalesce(col(a), col(b))


def nullif(a: Value, b: Value) -> Column:
    return F.nullif(col(a), col(b))


def greatest(*xs: Value) -> Column:
    """NULL if any argument is."""
    return F.when(all_known(*xs), F.greatest(*cols(xs)))


def least(*xs: Value) -> Column:
    return F.when(all_known(*xs), F.least(*cols(xs)))


def interval(n: Value, *bounds: Value) -> Column:
    """The place of the last of the rising bounds that isn't above n; -1 for NULL."""
    n = col(n)
    return F.when(n.isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*cols(bounds)), lambda b: b <= n)))


def strcmp(a: Value, b: Value) -> Column:
    a, b = text(a), text(b)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def case(*pairs: tuple[Value, Value], otherwise: Value = None, of: Value = None) -> Column:
    """CASE WHEN ... END over (condition, value) pairs, or CASE of WHEN ... END."""
    out = None
    for condition, value in pairs:
        test = col(condition) if of is None else col(of) == col(condition)
        out = F.when(test, col(value)) if out is None else out.when(test, col(value))
    return out.otherwise(col(otherwise))


def if_(condition: Value, a: Value, b: Value) -> Column:
    return F.when(col(condition), col(a)).otherwise(col(b))


def and_(*xs: Value) -> Column:
    out = col(xs[0])
    for x in xs[1:]:
        out = out & col(x)
    return out


def or_(*xs: Value) -> Column:
    out = col(xs[0])
    for x in xs[1:]:
        out = out | col(x)
    return out


def not_(x: Value) -> Column:
    return ~col(x)


def xor(a: Value, b: Value) -> Column:
    return col(a) != col(b)
