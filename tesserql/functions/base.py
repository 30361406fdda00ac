"""Arguments of expression helpers: columns as they are, anything else as a literal."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Any


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def cols(xs) -> list[Column]:
    return [col(x) for x in xs]


def text(x: Value) -> Column:
    return col(x).cast("string")


def all_known(*xs: Value) -> Column:
    """True where no argument is NULL."""
    return reduce(lambda a, b: a & b, [col(x).isNotNull() for x in xs])


def any_null(*xs: Value) -> Column:
    return ~all_known(*xs)


#: What a backslash makes of the letter after it; others stand for themselves.
ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}


def unquoted(raw: str) -> str:
    """The text that a quoted literal stands for."""
    mark = raw[0]
    return re.sub(rf"\\(.)|{mark}{mark}", lambda m: ESCAPES.get(m[1], m[1]) if m[1] else mark, raw[1:-1], flags=re.S)
