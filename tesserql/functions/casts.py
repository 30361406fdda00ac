"""CAST and CONVERT: MySQL's lenient conversions, in terms of casts that never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Value, col, text
from .maths import U64, unsigned

PREFIX = r"^[ \t\n]*([-+]?[0-9]+)"
REAL_PREFIX = r"^[ \t\n]*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"


def char(x: Value, n: int | None = None) -> Column:
    return text(x) if n is None else F.left(text(x), F.lit(n))


nchar = char


def binary(x: Value, n: int | None = None) -> Column:
    return F.encode(char(x, n), "UTF-8")


def signed(x: Value) -> Column:
    """The whole number that a string begins with, or 0; numbers are rounded."""
    s = text(x)
    whole = F.round(s.try_cast("decimal(38,10)"), 0).try_cast("bigint")
    prefix = F.regexp_extract(s, PREFIX, 1).try_cast("bigint")
    return F.when(s.isNotNull(), F.coalesce(whole, prefix, F.lit(0).cast("bigint")))


def unsigned_(x: Value) -> Column:
    return unsigned(signed(x)).cast(U64)


def real(x: Value) -> Column:
    s = text(x)
    return F.when(s.isNotNull(), F.coalesce(F.regexp_extract(s, REAL_PREFIX, 1).try_cast("double"), F.lit(0.0)))


def decimal(x: Value, p: int, s: int) -> Column:
    """Half-up; a precision above 38 isn't representable and is refused."""
    if not 0 < p <= 38 or not 0 <= s <= min(p, 30):
        raise ValueError(f"DECIMAL({p},{s}): precision up to 38 and scale up to 30")
    value = F.regexp_extract(text(x), REAL_PREFIX, 1).try_cast(f"decimal({p},{s})")
    return F.when(text(x).isNotNull(), F.coalesce(value, F.lit(0).cast(f"decimal({p},{s})")))


def date(x: Value) -> Column:
    return col(x).try_cast("date")


def datetime(x: Value, digits: int = 0) -> Column:
    """Rounded to that many digits of a second."""
    step = 10 ** (6 - digits)
    stamp = col(x).try_cast("timestamp")
    return F.timestamp_micros((F.floor((F.unix_micros(stamp) + step // 2) / step) * step).cast("long"))


def time(x: Value) -> Column:
    """Seconds of a day as an interval; hours may pass 23, as in '100:00:01'."""
    from .temporal import seconds, time_of

    return time_of(seconds(x))


#: Character sets and what the JVM calls them.
CHARSETS = {"utf8": "UTF-8", "utf8mb3": "UTF-8", "utf8mb4": "UTF-8", "latin1": "ISO-8859-1", "ascii": "US-ASCII", "utf16": "UTF-16BE", "utf16le": "UTF-16LE", "utf32": "UTF-32", "binary": "UTF-8"}


def convert_using(x: Value, charset: str) -> Column:
    """A character that the set lacks becomes a question mark, character by character, as texts stay texts."""
    name = CHARSETS.get(charset.lower(), charset)
    if name not in ("ISO-8859-1", "US-ASCII"):
        return F.decode(F.encode(text(x), name), name)
    return F.regexp_replace(text(x), "[^\\x{00}-\\x{7F}]" if name == "US-ASCII" else "[^\\x{00}-\\x{FF}]", "?")
