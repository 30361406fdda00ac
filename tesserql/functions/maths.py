"""Math, arithmetic and bit functions: NULL where MySQL has NULL and Spark would give NaN, Infinity or an error."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Value, col

UNSIGNED = 1 << 64
U64 = "decimal(20,0)"


def number(x: Value) -> Column:
    return col(x).cast("double")


def abs_(x: Value) -> Column:
    return F.abs(col(x))


def acos(x: Value) -> Column:
    return F.when(F.abs(number(x)) <= 1, F.acos(number(x)))


def asin(x: Value) -> Column:
    return F.when(F.abs(number(x)) <= 1, F.asin(number(x)))


def atan(y: Value, x: Value | None = None) -> Column:
    return F.atan(number(y)) if x is None else F.atan2(number(y), number(x))


atan2 = atan


def conv(n: Value, source: int, target: int) -> Column:
    """Bases from 2 to 36, or NULL."""
    ok = 2 <= abs(source) <= 36 and 2 <= abs(target) <= 36
    return F.conv(col(n).cast("string"), source, target) if ok else F.lit(None).cast("string")


def bin_(n: Value) -> Column:
    return F.bin(col(n).cast("long"))


def ceil(x: Value) -> Column:
    return F.ceil(col(x))


ceiling = ceil


def cos(x: Value) -> Column:
    return F.cos(number(x))


def cot(x: Value) -> Column:
    return F.when(F.tan(number(x)) != 0, F.cot(number(x)))


def crc32(s: Value) -> Column:
    return F.crc32(col(s).cast("string").cast("binary"))


def degrees(x: Value) -> Column:
    return F.degrees(number(x))


def exp(x: Value) -> Column:
    return F.exp(number(x))


def floor(x: Value) -> Column:
    return F.floor(col(x))


def ln(x: Value) -> Column:
    return F.when(number(x) > 0, F.ln(number(x)))


def log(a: Value, b: Value | None = None) -> Column:
    """LOG(x), or LOG(base, x); NULL outside the domain, and for base 1."""
    if b is None:
        return ln(a)
    return F.when((number(a) > 0) & (number(a) != 1) & (number(b) > 0), F.ln(number(b)) / F.ln(number(a)))


def log10(x: Value) -> Column:
    return F.when(number(x) > 0, F.log10(number(x)))


def log2(x: Value) -> Column:
    return F.when(number(x) > 0, F.log2(number(x)))


def md5(s: Value) -> Column:
    return F.md5(col(s).cast("string").cast("binary"))


def pi() -> Column:
    return F.pi()


def pow_(x: Value, y: Value) -> Column:
    return F.pow(number(x), number(y))


power = pow_


def radians(x: Value) -> Column:
    return F.radians(number(x))


def rand(seed: int | None = None) -> Column:
    return F.rand(seed)


def round_(x: Value, d: int = 0) -> Column:
    return F.round(col(x), d)


def sign(x: Value) -> Column:
    return F.signum(number(x)).cast("int")


def sin(x: Value) -> Column:
    return F.sin(number(x))


def sqrt(x: Value) -> Column:
    return F.when(number(x) >= 0, F.sqrt(number(x)))


def tan(x: Value) -> Column:
    return F.tan(number(x))


def truncate(x: Value, d: int) -> Column:
    """Toward zero; decimal, so that no digit is lost to binary fractions."""
    x = col(x).cast("decimal(28,8)")
    scale = 10 ** abs(d)
    moved = x * F.lit(scale) if d >= 0 else x / F.lit(scale)
    whole = F.signum(x.cast("double")).cast("int") * F.floor(F.abs(moved))
    return (whole / F.lit(scale) if d >= 0 else whole * F.lit(scale)).cast("double")


def plus(a: Value, b: Value) -> Column:
    return col(a) + col(b)


def minus(a: Value, b: Value) -> Column:
    return col(a) - col(b)


def times(a: Value, b: Value) -> Column:
    return col(a) * col(b)


def divide(a: Value, b: Value) -> Column:
    """NULL for a zero divisor."""
    return F.try_divide(col(a), col(b))


def div(a: Value, b: Value) -> Column:
    """Integer division toward zero; NULL for a zero divisor."""
    a, b = col(a).cast("decimal(28,6)"), col(b).cast("decimal(28,6)")
    return F.when(b != 0, F.call_function("div", a, b))


def mod(a: Value, b: Value) -> Column:
    """The dividend's sign; NULL for a zero divisor."""
    return F.try_mod(col(a), col(b))


def neg(a: Value) -> Column:
    return -col(a)


def unsigned(x: Value) -> Column:
    """A 64-bit integer as MySQL's unsigned value."""
    x = col(x).cast(U64)
    return F.when(x < 0, x + F.lit(Decimal(UNSIGNED))).otherwise(x).cast(U64)


def bit_and(a: Value, b: Value) -> Column:
    return unsigned(col(a).cast("long").bitwiseAND(col(b).cast("long")))


def bit_or(a: Value, b: Value) -> Column:
    return unsigned(col(a).cast("long").bitwiseOR(col(b).cast("long")))


def bit_xor(a: Value, b: Value) -> Column:
    return unsigned(col(a).cast("long").bitwiseXOR(col(b).cast("long")))


def bit_not(a: Value) -> Column:
    return unsigned(F.bitwise_not(col(a).cast("long")))


def shift_left(a: Value, n: Value) -> Column:
    """Bits beyond the 64th are lost; a shift by 64 or more gives 0."""
    n = col(n).cast("int")
    return unsigned(F.when((n >= 0) & (n < 64), F.call_function("shiftleft", col(a).cast("long"), n)).when(n.isNotNull(), F.lit(0).cast("long")))


def shift_right(a: Value, n: Value) -> Column:
    n = col(n).cast("int")
    return unsigned(F.when((n >= 0) & (n < 64), F.call_function("shiftrightunsigned", col(a).cast("long"), n)).when(n.isNotNull(), F.lit(0).cast("long")))


def bit_count(n: Value) -> Column:
    return F.bit_count(col(n).cast("long"))
