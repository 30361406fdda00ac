"""Date and time functions. A TIME value is a day-time interval within 838:59:59; `time_text` writes it as hh:mm:ss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Value, col, text

TIME_LIMIT = 838 * 3600 + 59 * 60 + 59
ZERO_DAY = "0001-01-01"
#: TO_DAYS of ZERO_DAY.
ZERO_DAYS = 366

# The format of each date, time and datetime standard.
FORMATS = {
    ("DATE", "USA"): "%m.%d.%Y",
    ("DATE", "JIS"): "%Y-%m-%d",
    ("DATE", "ISO"): "%Y-%m-%d",
    ("DATE", "EUR"): "%d.%m.%Y",
    ("DATE", "INTERNAL"): "%Y%m%d",
    ("TIME", "USA"): "%h:%i:%s %p",
    ("TIME", "JIS"): "%H:%i:%s",
    ("TIME", "ISO"): "%H:%i:%s",
    ("TIME", "EUR"): "%H.%i.%s",
    ("TIME", "INTERNAL"): "%H%i%s",
    ("DATETIME", "USA"): "%Y-%m-%d %H.%i.%s",
    ("DATETIME", "JIS"): "%Y-%m-%d %H:%i:%s",
    ("DATETIME", "ISO"): "%Y-%m-%d %H:%i:%s",
    ("DATETIME", "EUR"): "%Y-%m-%d %H.%i.%s",
    ("DATETIME", "INTERNAL"): "%Y%m%d%H%i%s",
}

# Format codes and the patterns of `date_format` that write the same.
CODES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "M": "MMMM", "b": "MMM", "d": "dd", "e": "d",
    "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS",
    "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a", "p": "a",
}


def seconds_of_day(t: Value) -> Column:
    t = col(t)
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


# --- parts -------------------------------------------------------------------------------------------------------


def date(t: Value) -> Column:
    return col(t).try_cast("date")


def year(t: Value) -> Column:
    return F.year(col(t))


def quarter(t: Value) -> Column:
    return F.quarter(col(t))


def month(t: Value) -> Column:
    return F.month(col(t))


def day(t: Value) -> Column:
    return F.dayofmonth(col(t))


dayofmonth = day


def dayofweek(t: Value) -> Column:
    return F.dayofweek(col(t))


def weekday(t: Value) -> Column:
    return F.weekday(col(t))


def dayofyear(t: Value) -> Column:
    return F.dayofyear(col(t))


def hour(t: Value) -> Column:
    return F.hour(col(t))


def minute(t: Value) -> Column:
    return F.minute(col(t))


def second(t: Value) -> Column:
    return F.second(col(t))


def microsecond(t: Value) -> Column:
    return F.pmod(F.unix_micros(col(t).cast("timestamp")), F.lit(1_000_000)).cast("int")


def dayname(t: Value) -> Column:
    return F.date_format(col(t), "EEEE")


def monthname(t: Value) -> Column:
    return F.date_format(col(t), "MMMM")


def last_day(t: Value) -> Column:
    return F.last_day(col(t))


def week_and_year(t: Value, mode: int = 0) -> tuple[Column, Column]:
    """WEEK(t, mode) and the year that the week belongs to.

    Mode bits: 1 the week starts on Monday; 2 weeks run from 1 to 53, so days before week 1 belong to the last year's; 4 week 1 is the first that
    starts in the year (else the first with four days or more in it). Bit 4 is turned round for weeks that start on Sunday.
    """
    t = col(t)
    monday, whole = bool(mode & 1), bool(mode & 2)
    first_full = bool(mode & 4) if monday else not mode & 4

    def weekday_of(d: Column) -> Column:
        return F.weekday(d) if monday else F.dayofweek(d) - 1

    def first_week(y: Column) -> Column:
        """Days from 1 January to the start of week 1."""
        w = weekday_of(F.make_date(y, F.lit(1), F.lit(1)))
        limit = 0 if first_full else 3
        return F.when(w <= limit, -w).otherwise(7 - w)

    y = F.year(t)
    since = F.dayofyear(t) - 1 - first_week(y)
    own = F.floor(since / 7) + 1
    if not whole:
        return F.when(since < 0, 0).otherwise(own).cast("int"), y
    before = y - 1
    length = F.dayofyear(F.make_date(before, F.lit(12), F.lit(31)))
    last = F.floor((since + first_week(y) + length - first_week(before)) / 7) + 1
    ahead = F.dayofyear(F.make_date(y, F.lit(12), F.lit(31))) + first_week(y + 1)
    next_year = F.dayofyear(t) - 1 >= ahead
    week = F.when(since < 0, last).when(next_year, 1).otherwise(own)
    return week.cast("int"), F.when(since < 0, before).when(next_year, y + 1).otherwise(y).cast("int")


def week(t: Value, mode: int = 0) -> Column:
    return week_and_year(t, mode)[0]


def weekofyear(t: Value) -> Column:
    return F.weekofyear(col(t))


def yearweek(t: Value, mode: int = 0) -> Column:
    w, y = week_and_year(t, mode | 2)
    return (y * 100 + w).cast("int")


def extract(unit: str, t: Value) -> Column:
    """EXTRACT(unit FROM t); composite units are packed into one number."""
    t, unit = col(t), unit.upper()
    simple = {"YEAR": year, "QUARTER": quarter, "MONTH": month, "DAY": day, "HOUR": hour, "MINUTE": minute, "SECOND": second, "MICROSECOND": microsecond}
    if unit in simple:
        return simple[unit](t).cast("long")
    if unit == "WEEK":
        return week(t, 0).cast("long")
    if unit == "YEAR_MONTH":
        return (F.year(t) * 100 + F.month(t)).cast("long")
    names = ["DAY", "HOUR", "MINUTE", "SECOND"]
    first, last = unit.split("_")
    out = F.lit(0).cast("long")
    for name in names[names.index(first) : (len(names) if last == "MICROSECOND" else names.index(last) + 1)]:
        out = out * 100 + simple[name](t)
    return out * 1_000_000 + microsecond(t) if last == "MICROSECOND" else out


# --- now ---------------------------------------------------------------------------------------------------------


def curdate() -> Column:
    return F.current_date()


def utc_timestamp() -> Column:
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())


def utc_date() -> Column:
    return F.to_date(utc_timestamp())


def curtime() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


def utc_time() -> Column:
    return F.date_format(utc_timestamp(), "HH:mm:ss")


def now() -> Column:
    return F.localtimestamp()


sysdate = now


# --- arithmetic --------------------------------------------------------------------------------------------------


def datediff(a: Value, b: Value) -> Column:
    return F.datediff(col(a), col(b))


def to_days(t: Value) -> Column:
    return (F.datediff(col(t), F.lit(ZERO_DAY).cast("date")) + ZERO_DAYS).cast("long")


def from_days(n: Value) -> Column:
    return F.date_add(F.lit(ZERO_DAY).cast("date"), (col(n) - ZERO_DAYS).cast("int"))


def to_seconds(t: Value) -> Column:
    return to_days(t) * 86400 + seconds_of_day(t)


def unix_timestamp(t: Value | None = None) -> Column:
    return F.unix_timestamp() if t is None else F.unix_timestamp(col(t))


def from_unixtime(s: Value, fmt: str | None = None) -> Column:
    at = F.timestamp_seconds(col(s))
    return at if fmt is None else date_format(at, fmt)


def makedate(y: Value, day_of_year: Value) -> Column:
    """NULL for days below 1; years of two digits are 1970 to 2069."""
    y, n = col(y).cast("int"), col(day_of_year).cast("int")
    y = F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)
    return F.when(n > 0, F.date_add(F.make_date(y, F.lit(1), F.lit(1)), n - 1))


def maketime(h: Value, m: Value, s: Value) -> Column:
    h, m, s = (col(x).cast("long") for x in (h, m, s))
    whole = F.abs(h) * 3600 + m * 60 + s
    return F.when(m.between(0, 59) & s.between(0, 59), time_of(F.when(h < 0, -whole).otherwise(whole)))


def period_add(period: Value, months: Value) -> Column:
    """YYYYMM or YYMM, and months."""
    n = _months(period) + col(months).cast("long")
    return F.call_function("div", n, F.lit(12)) * 100 + n % 12 + 1


def period_diff(a: Value, b: Value) -> Column:
    return _months(a) - _months(b)


def _months(period: Value) -> Column:
    p = col(period).cast("long")
    y = F.call_function("div", p, F.lit(100))
    return F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y) * 12 + p % 100 - 1


def date_add(t: Value, n: Value, unit: str) -> Column:
    """DATE_ADD(t, INTERVAL n unit): month ends are kept within the month; a date stays one under units of days and more.

    Composite units take n as a text of the parts, such as '1:30' for MINUTE_SECOND; a sign counts for all parts.
    """
    t, unit = col(t), unit.upper()
    if "_" in unit:
        names = ["YEAR", "MONTH"] if unit == "YEAR_MONTH" else ["DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND"]
        first, last = unit.split("_")
        names = names[names.index(first) : names.index(last) + 1]
        raw = text(n)
        sign = F.when(raw.startswith("-"), -1).otherwise(1)
        parts = F.regexp_extract_all(raw, F.lit(r"[0-9]+"), F.lit(0))
        gap = len(names) - F.size(parts)  # missing parts are the leading ones
        at = lambda i: F.when(F.lit(i) < gap, F.lit(0).cast("long")).otherwise(F.get(parts, F.lit(i) - gap).cast("long"))
        for i, name in enumerate(names):
            t = date_add(t, sign * at(i), name)
        return t
    n = col(n).cast("long")
    months = {"YEAR": 12, "QUARTER": 3, "MONTH": 1}
    if unit in months:
        return t + F.make_ym_interval(F.lit(0), (n * months[unit]).cast("int"))
    if unit in ("DAY", "WEEK"):
        return t + F.make_dt_interval((n * (7 if unit == "WEEK" else 1)).cast("int"))
    micros = {"HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000, "MICROSECOND": 1}[unit]
    return F.timestamp_micros(F.unix_micros(t.cast("timestamp")) + n * micros)


adddate = timestampadd = date_add


def date_sub(t: Value, n: Value, unit: str) -> Column:
    if "_" in unit:
        raw = text(n)
        return date_add(t, F.when(raw.startswith("-"), F.substring(raw, F.lit(2), F.char_length(raw))).otherwise(F.concat(F.lit("-"), raw)), unit)
    return date_add(t, -col(n).cast("long"), unit)


subdate = date_sub


def timestampdiff(unit: str, a: Value, b: Value) -> Column:
    """Whole units from a to b."""
    a, b, unit = col(a).cast("timestamp"), col(b).cast("timestamp"), unit.upper()
    months = {"YEAR": 12, "QUARTER": 3, "MONTH": 1}
    if unit in months:
        whole = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        rest = lambda t: F.dayofmonth(t).cast("long") * 86_400_000_000 + seconds_of_day(t).cast("long") * 1_000_000 + microsecond(t)
        whole = whole + F.when((whole > 0) & (rest(b) < rest(a)), -1).when((whole < 0) & (rest(b) > rest(a)), 1).otherwise(0)
        return F.call_function("div", whole.cast("long"), F.lit(months[unit]))
    micros = {"WEEK": 604_800_000_000, "DAY": 86_400_000_000, "HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000, "MICROSECOND": 1}[unit]
    return F.call_function("div", F.unix_micros(b) - F.unix_micros(a), F.lit(micros).cast("long"))


def convert_tz(t: Value, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), col(t).cast("timestamp_ntz"))


# --- TIME values -------------------------------------------------------------------------------------------------


def time_of(n: Value) -> Column:
    """Seconds as a TIME, within its limits."""
    n = col(n).cast("long")
    n = F.greatest(F.least(n, F.lit(TIME_LIMIT)), F.lit(-TIME_LIMIT))
    return F.when(col(n).isNotNull(), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)")))


sec_to_time = time_of


def seconds(t: Value) -> Column:
    """Signed seconds of a text '[-]hh:mm:ss'."""
    s = text(t)
    part = lambda i: F.coalesce(F.regexp_extract(s, r"^-?([0-9]+):([0-9]+)(?::([0-9]+))?", i).try_cast("long"), F.lit(0).cast("long"))
    whole = part(1) * 3600 + part(2) * 60 + part(3)
    return F.when(s.rlike(r"^-?[0-9]+:[0-9]+"), F.when(s.startswith("-"), -whole).otherwise(whole))


def interval_seconds(t: Value) -> Column:
    return col(t).cast("interval second").cast("decimal(20,6)").cast("long")


def time_to_sec(t: Value) -> Column:
    return seconds_of_day(t).cast("long")


def time(t: Value) -> Column:
    return time_of(seconds_of_day(t))


def time_text(t: Value) -> Column:
    """A TIME as [-]hh:mm:ss."""
    n = interval_seconds(t)
    a = F.abs(n)
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    div = lambda x, k: F.call_function("div", x, F.lit(k).cast("long"))
    return F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")), two(div(a, 3600)), F.lit(":"), two(div(a, 60) % 60), F.lit(":"), two(a % 60))


def addtime(t: Value, dt: Value) -> Column:
    return col(t) + col(dt)


def subtime(t: Value, dt: Value) -> Column:
    return col(t) - col(dt)


def timediff(a: Value, b: Value) -> Column:
    return time_of(F.call_function("div", F.unix_micros(col(a).cast("timestamp")) - F.unix_micros(col(b).cast("timestamp")), F.lit(1_000_000).cast("long")))


# --- formats -----------------------------------------------------------------------------------------------------


def date_format(t: Value, fmt: str) -> Column:
    """DATE_FORMAT for a literal format: pieces that `date_format` can write, and expressions for the other codes."""
    t = col(t)
    own = {
        "w": lambda: F.dayofweek(t) - 1,
        "U": lambda: F.lpad(week(t, 0).cast("string"), 2, "0"),
        "u": lambda: F.lpad(week(t, 1).cast("string"), 2, "0"),
        "V": lambda: F.lpad(week(t, 2).cast("string"), 2, "0"),
        "v": lambda: F.lpad(week(t, 3).cast("string"), 2, "0"),
        "X": lambda: week_and_year(t, 2)[1],
        "x": lambda: week_and_year(t, 3)[1],
        "D": lambda: F.concat(F.dayofmonth(t).cast("string"), F.when(F.dayofmonth(t).between(11, 13), "th").when(F.dayofmonth(t) % 10 == 1, "st").when(F.dayofmonth(t) % 10 == 2, "nd").when(F.dayofmonth(t) % 10 == 3, "rd").otherwise("th")),
    }
    parts, i = [], 0
    while i < len(fmt):
        c = fmt[i]
        if c == "%" and i + 1 < len(fmt):
            code, i = fmt[i + 1], i + 2
            parts.append(F.date_format(t, CODES[code]) if code in CODES else own[code]().cast("string") if code in own else F.lit(code))
        else:
            parts.append(F.lit(c))
            i += 1
    return F.when(t.isNotNull(), F.concat(*parts) if parts else F.lit(""))


def time_format(t: Value, fmt: str) -> Column:
    """TIME_FORMAT: codes of dates write zeros."""
    zeros = {"Y": "0000", "y": "00", "m": "00", "c": "0", "d": "00", "e": "0"}
    for code, out in zeros.items():
        fmt = fmt.replace("%" + code, out)
    return date_format(t, fmt)


def get_format(kind: str, standard: str) -> Column:
    kind = "DATETIME" if kind.upper() == "TIMESTAMP" else kind.upper()
    return F.lit(FORMATS.get((kind, standard.upper())))


def java_pattern(fmt: str) -> str:
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            out, i = out + CODES[fmt[i + 1]], i + 2
        else:
            out, i = out + (f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]), i + 1
    return out


def str_to_date(s: Value, fmt: str) -> Column:
    """A date, a TIME or a timestamp, as the format's codes say; NULL for texts that don't fit."""
    codes = {fmt[i + 1] for i, c in enumerate(fmt[:-1]) if c == "%"}
    of_time, of_date = codes & set("HkhIlisSfTrp"), codes - set("HkhIlisSfTrp")
    stamp = F.try_to_timestamp(text(s), F.lit(java_pattern(fmt)))
    return stamp if of_time and of_date else time(stamp) if of_time else stamp.cast("date")
