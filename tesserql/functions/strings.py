"""String functions with MySQL semantics, as expressions that stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Value, all_known, col, cols, text


def ascii_(s: Value) -> Column:
    return F.ascii(text(s))


def bit_length(s: Value) -> Column:
    return F.bit_length(text(s))


def char(*codes: Value) -> Column:
    """CHAR(n, ...): the bytes of each integer; NULL arguments are left out."""
    parts = []
    for n in cols(codes):
        digits = F.hex(n.cast("long"))
        parts.append(F.coalesce(F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits), F.lit("")))
    return F.decode(F.unhex(F.concat(*parts)), "UTF-8")


def char_length(s: Value) -> Column:
    return F.char_length(text(s))


def concat(*parts: Value) -> Column:
    return F.concat(*[text(p) for p in parts])


def concat_ws(sep: str, *parts: Value) -> Column:
    return F.concat_ws(sep, *[text(p) for p in parts])


def elt(n: Value, *parts: Value) -> Column:
    at = col(n).cast("int")
    return F.when((at >= 1) & (at <= len(parts)), F.get(F.array(*[text(p) for p in parts]), at - 1))


def field(x: Value, *parts: Value) -> Column:
    """The first place of x among parts; 0 for none, and for NULL."""
    out = F.lit(0)
    for i, p in reversed(list(enumerate(cols(parts), 1))):
        out = F.when(F.coalesce(col(x) == p, F.lit(False)), F.lit(i)).otherwise(out)
    return out


def find_in_set(s: Value, items: Value) -> Column:
    return F.find_in_set(text(s), text(items))


def format_number(x: Value, places: int) -> Column:
    """FORMAT(x, d): half-up rounding, thousands in groups."""
    d = max(places, 0)
    return F.format_number(F.round(col(x).cast("decimal(38,10)"), d), d)


def hex_(x: Value, numeric: bool = False) -> Column:
    return F.hex(F.round(col(x)).cast("long")) if numeric else F.hex(text(x))


def insert(s: Value, pos: Value, length: Value, new: Value) -> Column:
    """INSERT(): s where pos is outside it; to the end where length is negative or past it."""
    s, pos, length, new = text(s), col(pos).cast("int"), col(length).cast("int"), text(new)
    size = F.char_length(s)
    over = F.when((length < 0) | (pos + length > size), size - pos + 1).otherwise(length)
    made = F.concat(F.substring(s, F.lit(1), pos - 1), new, F.substring(s, pos + over, size))
    return F.when(all_known(s, pos, length, new), F.when((pos < 1) | (pos > size), s).otherwise(made))


def instr(s: Value, sub: Value) -> Column:
    return F.instr(text(s), text(sub))


def left(s: Value, n: Value) -> Column:
    return F.left(text(s), col(n).cast("int"))


def length(s: Value) -> Column:
    return F.octet_length(text(s))


def locate(sub: Value, s: Value, pos: Value = 1) -> Column:
    return F.position(text(sub), text(s), col(pos).cast("int"))


def lower(s: Value) -> Column:
    return F.lower(text(s))


lcase = lower


def _pad(s: Value, n: Value, pad: Value, how) -> Column:
    s, n, pad = text(s), col(n).cast("int"), text(pad)
    return F.when((n < 0) | ((pad == "") & (n > F.char_length(s))), F.lit(None)).otherwise(how(s, n, pad))


def lpad(s: Value, n: Value, pad: Value) -> Column:
    """NULL for a negative length, and where padding is needed and there is none."""
    return _pad(s, n, pad, F.lpad)


def rpad(s: Value, n: Value, pad: Value) -> Column:
    return _pad(s, n, pad, F.rpad)


def ltrim(s: Value) -> Column:
    return F.ltrim(text(s))


def make_set(bits: Value, *parts: Value) -> Column:
    b = col(bits).cast("long")
    chosen = [F.when(b.bitwiseAND(F.lit(1 << i).cast("long")) != 0, text(p)) for i, p in enumerate(parts)]
    return F.when(b.isNotNull(), F.concat_ws(",", *chosen))


def ord_(s: Value) -> Column:
    """The code of the first character: its UTF-8 bytes as one number."""
    first = F.left(text(s), F.lit(1))
    return F.when(first == "", F.lit(0).cast("long")).otherwise(F.conv(F.hex(F.encode(first, "UTF-8")), 16, 10).cast("long"))


def quote(s: Value) -> Column:
    """A quoted literal; the word NULL for NULL."""
    escaped = text(s)
    for raw, out in (("\\", "\\\\"), ("'", "\\'"), ("\0", "\\0"), ("\x1a", "\\Z")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(out))
    return F.coalesce(F.concat(F.lit("'"), escaped, F.lit("'")), F.lit("NULL"))


def repeat(s: Value, n: Value) -> Column:
    return F.repeat(text(s), F.greatest(col(n).cast("int"), F.lit(0)))


def replace(s: Value, old: Value, new: Value) -> Column:
    return F.replace(text(s), text(old), text(new))


def reverse(s: Value) -> Column:
    return F.reverse(text(s))


def right(s: Value, n: Value) -> Column:
    return F.right(text(s), col(n).cast("int"))


def rtrim(s: Value) -> Column:
    return F.rtrim(text(s))


def soundex(s: Value) -> Column:
    """The long form: codes of all letters, runs of one code once (also across vowels), at least four characters."""
    letters = F.upper(F.regexp_replace(text(s), "[^A-Za-z]", ""))
    codes = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    tail = F.replace(F.substring(codes, F.lit(2), F.char_length(codes)), F.lit("0"), F.lit(""))
    runs = F.regexp_replace(F.concat(F.left(codes, F.lit(1)), tail), r"(.)\1+", "$1")
    made = F.concat(F.left(letters, F.lit(1)), F.substring(runs, F.lit(2), F.char_length(runs)))
    return F.when(letters == "", F.lit("")).otherwise(F.when(F.char_length(made) < 4, F.rpad(made, 4, "0")).otherwise(made))


def space(n: Value) -> Column:
    return repeat(" ", n)


def substring(s: Value, pos: Value, n: Value | None = None) -> Column:
    """From 1, or from the end for a negative position; position 0, and one before the start, give ''."""
    s, pos = text(s), col(pos).cast("int")
    size = F.char_length(s)
    start = F.when(pos < 0, size + pos + 1).otherwise(pos)
    count = F.lit(2**31 - 1) if n is None else F.greatest(col(n).cast("int"), F.lit(0))
    out = F.when((pos == 0) | (start < 1), F.lit("")).otherwise(F.substring(s, start, count))
    return F.when(all_known(s, pos, *([] if n is None else [n])), out)


substr = mid = substring


def substring_index(s: Value, delimiter: str, n: int) -> Column:
    return F.substring_index(text(s), delimiter, n)


def trim(s: Value, remove: str | None = None, where: str = "both") -> Column:
    """TRIM([LEADING | TRAILING | BOTH] remove FROM s): whole copies of `remove`."""
    import re

    unit = f"(?:{re.escape(' ' if remove is None else remove)})+"
    out = text(s)
    if remove == "":
        return out
    if where in ("both", "leading"):
        out = F.regexp_replace(out, f"^{unit}", "")
    return F.regexp_replace(out, f"{unit}$", "") if where in ("both", "trailing") else out


def unhex(s: Value) -> Column:
    """NULL for what isn't pairs of hexadecimal digits."""
    s = text(s)
    padded = F.when(F.length(s) % 2 == 1, F.concat(F.lit("0"), s)).otherwise(s)
    return F.when(s.rlike("^[0-9A-Fa-f]*$"), F.decode(F.unhex(padded), "UTF-8"))


def upper(s: Value) -> Column:
    return F.upper(text(s))


ucase = upper


def uuid() -> Column:
    return F.expr("uuid()")


def load_file(_: Value) -> Column:
    raise NotImplementedError("LOAD_FILE reads the server's files and isn't supported")
