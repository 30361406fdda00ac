"""MySQL text to Spark SQL.

A statement is read as tokens in nested parentheses; what Spark spells otherwise is rewritten, bottom up: operators (||, &&, !, XOR, ->, ->>), LIMIT with an offset
first, STRAIGHT_JOIN, locking clauses, quantified comparisons, intervals, GROUP_CONCAT, and functions whose name or edge rules differ. A function that the library has as a helper (`tesserql.functions`) becomes the SQL of
the helper's expression over its arguments, so both have the same rules. `run` evaluates the result; named or positional parameters make a prepared statement.

Types aren't known here, so lenient conversions between texts and numbers are those of literals and functions; operators on columns of texts and numbers are Spark's.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import casts as C
from ..functions import compare as P
from ..functions import jsons as J
from ..functions import maths as M
from ..functions import strings as S
from ..functions import temporal as T
from ..functions.base import unquoted

TOKEN = re.compile(
    r"""(?P<space>\s+|--[ \t][^\n]*|\#[^\n]*|/\*.*?\*/)
      | (?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
      | (?P<name>`[^`]+`|[A-Za-z_$][\w$]*)
      | (?P<number>\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|\.\d+)
      | (?P<param>:[A-Za-z_]\w*|\?)
      | (?P<op><=>|->>|->|:=|\|\||&&|<<|>>|<=|>=|<>|!=|[-+*/%=<>!~^&|.,;@])
      | (?P<open>\()
      | (?P<close>\))""",
    re.X | re.S,
)


class Unsupported(ValueError):
    """What the dialect has and this engine refuses."""


def tokens(sql: str) -> list:
    """Strings, and lists for what stands in parentheses."""
    stack, at = [[]], 0
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if not m:
            raise Unsupported(f"can't read: {sql[at : at + 20]!r}")
        at, kind, raw = m.end(), m.lastgroup, m.group()
        if kind == "open":
            stack.append([])
        elif kind == "close":
            if len(stack) == 1:
                raise Unsupported("a parenthesis too many")
            inner = stack.pop()
            stack[-1].append(inner)
        elif kind != "space":
            stack[-1].append(raw)
    if len(stack) > 1:
        raise Unsupported("a parenthesis is open")
    while stack[0] and stack[0][-1] == ";":
        stack[0].pop()
    return stack[0]


def word(t) -> str:
    return t.upper() if isinstance(t, str) else ""


def text(ts: list) -> str:
    out = ""
    for t in ts:
        piece = f"({text(t)})" if isinstance(t, list) else t
        tight = piece == "." or out.endswith(".") or piece == "," or (isinstance(t, list) and re.search(r"[\w`]$", out) and not re.search(r"(?i)\b(in|and|or|not|on|from|join|where|as|select|when|then|else|by|values|union|all|exists|interval|having|between|like|using|over|group|distinct)$", out))
        out += piece if tight or not out else " " + piece
    return out


def split(ts: list, mark: str = ",") -> list[list]:
    out = [[]]
    for t in ts:
        if t == mark:
            out.append([])
        else:
            out[-1].append(t)
    return out if ts else []


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


STRING = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*\"""", re.S)
#: What an expression's own SQL has as a call: an operator's name must be quoted there.
CALLED = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)|(<=>|<=|>=|!=|[-+*/%<>=&|^~!]|\b(?:and|or|not)\b)(?=\()""", re.S)
DAY = re.compile(r"\d{4}-\d{1,2}-\d{1,2}")


def sql_of(c: Column) -> str:
    """The SQL of a helper's expression."""
    return CALLED.sub(lambda m: m[1] or f"`{m[2]}`", c._jc.node().sql())


def constant(raw: str):
    """The value of a literal argument."""
    raw = raw.strip()
    if STRING.fullmatch(raw):
        return unquoted(raw)
    if raw.upper() == "NULL":
        return None
    try:
        return int(raw.replace(" ", ""))
    except ValueError:
        raise Unsupported(f"{raw}: a literal is needed") from None


def helper(f: Callable[..., Column], days: bool = False) -> Callable[[list[str]], str]:
    """The SQL of f over texts of arguments; what f takes as a Python value is a literal there. `days`: literals of dates are dates."""
    parameters = list(inspect.signature(f).parameters.values())

    def call(args: list[str]) -> str:
        values = []
        for i, a in enumerate(args):
            if i >= len(parameters) and parameters[-1].kind is not inspect.Parameter.VAR_POSITIONAL:
                raise Unsupported(f"{f.__name__} with {len(args)} arguments")
            kind = str(parameters[min(i, len(parameters) - 1)].annotation)
            if "Value" not in kind:
                values.append(constant(a))
                continue
            if days and STRING.fullmatch(a) and DAY.match(unquoted(a)):
                a = f"{'date' if len(unquoted(a)) <= 10 else 'timestamp_ntz'}{a}"
            values.append(F.expr(a))
        try:
            return sql_of(f(*values))
        except (TypeError, KeyError, IndexError) as e:
            raise Unsupported(f"{f.__name__}({', '.join(args)}): {e}") from e

    return call


def json_extract(args: list[str]) -> str:
    """JSON_EXTRACT; paths with wildcards are walked by a function of their own."""
    paths = [constant(p) for p in args[1:]]
    if J.plain(paths):
        return sql_of(J.json_extract(F.expr(args[0]), *paths))
    name = f"tesserql_json_{abs(hash(tuple(paths))):x}"
    SparkSession.getActiveSession().udf.register(name, J.extractor(paths))
    return f"{name}(cast({args[0]} AS string))"


#: Functions by their names.
FUNCTIONS: dict[str, Callable[[list[str]], str]] = {
    name: helper(f)
    for name, f in {
        "ASCII": S.ascii_, "BIT_LENGTH": S.bit_length, "CHAR": S.char, "CHAR_LENGTH": S.char_length, "CHARACTER_LENGTH": S.char_length, "CONCAT": S.concat, "CONCAT_WS": S.concat_ws, "ELT": S.elt, "FIELD": S.field,
        "FIND_IN_SET": S.find_in_set, "HEX": S.hex_, "INSERT": S.insert, "INSTR": S.instr, "LEFT": S.left, "LENGTH": S.length, "OCTET_LENGTH": S.length, "LOCATE": S.locate, "LOWER": S.lower, "LCASE": S.lower, "LPAD": S.lpad,
        "LTRIM": S.ltrim, "MAKE_SET": S.make_set, "ORD": S.ord_, "QUOTE": S.quote, "REPEAT": S.repeat, "REPLACE": S.replace, "REVERSE": S.reverse, "RIGHT": S.right, "RPAD": S.rpad, "RTRIM": S.rtrim, "SOUNDEX": S.soundex,
        "SPACE": S.space, "SUBSTRING": S.substring, "SUBSTR": S.substring, "MID": S.substring, "SUBSTRING_INDEX": S.substring_index, "TRIM": S.trim, "UNHEX": S.unhex, "UPPER": S.upper, "UCASE": S.upper, "UUID": S.uuid,
        "LOAD_FILE": S.load_file, "JSON_UNQUOTE": J.json_unquote,
        "ABS": M.abs_, "ACOS": M.acos, "ASIN": M.asin, "ATAN": M.atan, "ATAN2": M.atan, "CONV": M.conv, "BIN": M.bin_, "CEIL": M.ceil, "CEILING": M.ceil, "COS": M.cos, "COT": M.cot, "CRC32": M.crc32, "DEGREES": M.degrees,
        "EXP": M.exp, "FLOOR": M.floor, "LN": M.ln, "LOG": M.log, "LOG10": M.log10, "LOG2": M.log2, "MD5": M.md5, "PI": M.pi, "POW": M.pow_, "POWER": M.pow_, "RADIANS": M.radians, "RAND": M.rand, "ROUND": M.round_,
        "SIGN": M.sign, "SIN": M.sin, "SQRT": M.sqrt, "TAN": M.tan, "TRUNCATE": M.truncate, "BIT_COUNT": M.bit_count, "MOD": M.mod,
        "IFNULL": P.ifnull, "NULLIF": P.nullif, "COALESCE": P.coalesce, "GREATEST": P.greatest, "LEAST": P.least, "INTERVAL": P.interval, "STRCMP": P.strcmp, "ISNULL": P.is_null,
        "STD": A.std, "STDDEV": A.std, "STDDEV_POP": A.std, "STDDEV_SAMP": A.stddev_samp, "VARIANCE": A.variance, "VAR_POP": A.variance, "VAR_SAMP": A.var_samp, "BIT_AND": A.bit_and, "BIT_OR": A.bit_or, "BIT_XOR": A.bit_xor,
        "ANY_VALUE": A.any_value,
    }.items()
} | {
    name: helper(f, days=True)
    for name, f in {
        "DATE": T.date, "YEAR": T.year, "QUARTER": T.quarter, "MONTH": T.month, "DAY": T.day, "DAYOFMONTH": T.day, "DAYOFWEEK": T.dayofweek, "WEEKDAY": T.weekday, "DAYOFYEAR": T.dayofyear, "HOUR": T.hour, "MINUTE": T.minute,
        "SECOND": T.second, "MICROSECOND": T.microsecond, "DAYNAME": T.dayname, "MONTHNAME": T.monthname, "LAST_DAY": T.last_day, "WEEK": T.week, "WEEKOFYEAR": T.weekofyear, "YEARWEEK": T.yearweek, "CURDATE": T.curdate,
        "CURRENT_DATE": T.curdate, "UTC_TIMESTAMP": T.utc_timestamp, "UTC_DATE": T.utc_date, "CURTIME": T.curtime, "CURRENT_TIME": T.curtime, "UTC_TIME": T.utc_time, "NOW": T.now, "SYSDATE": T.now, "CURRENT_TIMESTAMP": T.now,
        "LOCALTIME": T.now, "LOCALTIMESTAMP": T.now, "DATEDIFF": T.datediff, "TO_DAYS": T.to_days, "FROM_DAYS": T.from_days, "TO_SECONDS": T.to_seconds, "UNIX_TIMESTAMP": T.unix_timestamp, "FROM_UNIXTIME": T.from_unixtime,
        "MAKEDATE": T.makedate, "PERIOD_ADD": T.period_add, "PERIOD_DIFF": T.period_diff, "CONVERT_TZ": T.convert_tz, "TIME_TO_SEC": T.time_to_sec, "DATE_FORMAT": T.date_format, "TIME_FORMAT": T.time_format,
        "STR_TO_DATE": T.str_to_date,
    }.items()
} | {
    "FORMAT": lambda a: helper(S.format_number)(a[:2]),
    "IF": lambda a: sql_of(P.if_(P.truth(F.expr(numeric(a[0]))), F.expr(a[1]), F.expr(a[2]))),
    "JSON_EXTRACT": json_extract,
    "GET_FORMAT": lambda a: sql_of(T.get_format(a[0], constant(a[1]))),
    "TIMESTAMPDIFF": lambda a: sql_of(T.timestampdiff(a[0], *(F.expr(day(x)) for x in a[1:]))),
    "TIMESTAMPADD": lambda a: sql_of(T.date_add(F.expr(day(a[2])), F.expr(a[1]), a[0])),
    "MAKETIME": lambda a: times(T.maketime, a),
    "SEC_TO_TIME": lambda a: times(T.time_of, a),
    "TIME": lambda a: times(T.time, a),
    "TIMEDIFF": lambda a: times(T.timediff, a),
    "ADDTIME": lambda a: times(T.addtime, a),
    "SUBTIME": lambda a: times(T.subtime, a),
}
UNITS = frozenset("MICROSECOND SECOND MINUTE HOUR DAY WEEK MONTH QUARTER YEAR SECOND_MICROSECOND MINUTE_MICROSECOND MINUTE_SECOND HOUR_MICROSECOND HOUR_SECOND HOUR_MINUTE DAY_MICROSECOND DAY_SECOND DAY_MINUTE DAY_HOUR YEAR_MONTH".split())


def day(raw: str) -> str:
    """A literal of a date or time as one."""
    return f"{'date' if len(unquoted(raw)) <= 10 else 'timestamp_ntz'}{raw}" if STRING.fullmatch(raw) and DAY.match(unquoted(raw)) else raw


class Time(str):
    """The SQL of a TIME: an interval, which functions of dates don't take."""


def times(f: Callable[..., Column], args: list[str]) -> Time:
    return Time(sql_of(f(*(F.expr(day(a)) for a in args))))


def part(divisor: int, modulus: int | None) -> Callable[[str], str]:
    def of(t: str) -> str:
        n = F.call_function("div", F.abs(T.interval_seconds(F.expr(t))), F.lit(divisor).cast("long"))
        return sql_of((n if modulus is None else n % modulus).cast("int"))

    return of


#: What these functions make of a TIME.
OF_TIMES: dict[str, Callable[[str], str]] = {"TIME_TO_SEC": lambda t: sql_of(T.interval_seconds(F.expr(t))), "HOUR": part(3600, None), "MINUTE": part(60, 60), "SECOND": part(1, 60), "TIME": Time}


def argument(ts: list) -> str:
    """The text of an argument, still a TIME if it is one."""
    return ts[0] if len(ts) == 1 and isinstance(ts[0], Time) else text(ts)


def moved(what: str, amount: list, unit: str, back: bool) -> str:
    """what plus or minus INTERVAL amount unit."""
    n = text(amount)
    value = unquoted(n) if STRING.fullmatch(n) else F.expr(n)
    if isinstance(value, str) and "_" not in unit:
        value = F.lit(int(value))
    return sql_of((T.date_sub if back else T.date_add)(F.expr(day(what)), value, unit))


def interval_at(ts: list, i: int) -> tuple[list, str, int]:
    """(amount, unit, the place after it) of INTERVAL at i."""
    end = next((k for k in range(i + 2, len(ts)) if word(ts[k]) in UNITS), None)
    if end is None:
        raise Unsupported("INTERVAL without a unit")
    return ts[i + 1 : end], word(ts[end]), end + 1


def special(name: str, inner: list) -> str | None:
    """Functions whose arguments have words of their own."""
    words = [word(x) for x in inner]
    if name in ("DATE_ADD", "DATE_SUB", "ADDDATE", "SUBDATE"):
        first, second = split(inner)
        if word(second[0]) == "INTERVAL":
            amount, unit, _ = interval_at(second, 0)
            return moved(text(first), amount, unit, name in ("DATE_SUB", "SUBDATE"))
        return moved(text(first), second, "DAY", name in ("DATE_SUB", "SUBDATE"))
    if name == "EXTRACT" and "FROM" in words:
        at = words.index("FROM")
        return sql_of(T.extract(words[0], F.expr(day(text(inner[at + 1 :])))))
    if name == "TRIM" and "FROM" in words:
        at = words.index("FROM")
        where = words[0].lower() if words[0] in ("BOTH", "LEADING", "TRAILING") else "both"
        what = inner[1 if words[0] in ("BOTH", "LEADING", "TRAILING") else 0 : at]
        return sql_of(S.trim(F.expr(text(inner[at + 1 :])), constant(text(what)) if what else None, where))
    if name in ("SUBSTRING", "SUBSTR", "MID") and "FROM" in words:
        at = words.index("FROM")
        end = words.index("FOR") if "FOR" in words else len(inner)
        parts = [inner[:at], inner[at + 1 : end], *([inner[end + 1 :]] if end < len(inner) else [])]
        return FUNCTIONS["SUBSTRING"]([text(x) for x in parts])
    if name == "POSITION" and "IN" in words:
        at = words.index("IN")
        return FUNCTIONS["LOCATE"]([text(inner[:at]), text(inner[at + 1 :])])
    if name == "CHAR" and "USING" in words:
        return FUNCTIONS["CHAR"]([text(x) for x in split(inner[: words.index("USING")])])
    return None


def group_concat(inner: list) -> str:
    ts, distinct = inner, bool(inner) and word(inner[0]) == "DISTINCT"
    ts = ts[1:] if distinct else ts
    separator, order = "','", None
    for i, t in enumerate(ts):
        if word(t) == "SEPARATOR":
            ts, separator = ts[:i], ts[i + 1]
            break
    for i, t in enumerate(ts):
        if word(t) == "ORDER" and word(ts[i + 1]) == "BY":
            ts, order = ts[:i], text(ts[i + 2 :])
            break
    parts = [text(p) for p in split(ts)]
    value = f"cast({parts[0]} AS string)" if len(parts) == 1 else f"concat({', '.join(f'cast({p} AS string)' for p in parts)})"
    if distinct:
        # DISTINCT sorts by its own values, as what they are.
        key, _, way = (order or parts[0]).partition(" ") if len(parts) == 1 else (order or value, "", "")
        if (key, way.upper()) not in {(parts[0] if len(parts) == 1 else value, w) for w in ("", "ASC", "DESC")}:
            raise Unsupported(f"GROUP_CONCAT(DISTINCT ...) ORDER BY {order}")
        own = parts[0] if len(parts) == 1 else value
        joined = f"array_join(transform(sort_array(collect_set({own}), {'false' if way.upper() == 'DESC' else 'true'}), v -> cast(v AS string)), {separator})"
        return f"CASE WHEN count({own}) > 0 THEN left({joined}, 1024) END"
    within = f" WITHIN GROUP (ORDER BY {order})" if order else ""
    return f"left(listagg({value}, {separator}){within}, 1024)"


def all_equal(a: str, inner: list, every: bool) -> str:
    """a = ALL (sub-query); without `every`, a <> ANY (sub-query)."""
    q = lambda what: f"(SELECT {what} FROM ({text(inner)}) AS _q(_v))"
    differs = f"({a} <> {q('min(_v)')} OR {a} <> {q('max(_v)')})"
    none, some = ("TRUE", "FALSE") if every else ("FALSE", "TRUE")
    return f"CASE WHEN {q('count(*)')} = 0 THEN {none} WHEN {differs} THEN {some} WHEN {a} IS NOT NULL AND {q('count(*) = count(_v)')} THEN {none} END"


def quantifier(op: str, which: str, inner: list) -> list:
    """What stands for `op which (sub-query)`: a list of tokens after the left side."""
    every = which == "ALL"
    if op == "=" and not every:
        return ["IN", inner]
    if op in ("<>", "!=") and every:
        return ["NOT", "IN", inner]
    edge = ("max" if op[0] == ">" else "min") if every else ("min" if op[0] == ">" else "max")
    none = f"cast('{'-' if op[0] == '>' else ''}Infinity' AS double)"
    value = f"CASE WHEN count(*) = 0 THEN {none} WHEN count(*) = count(_v) THEN {edge}(_v) END" if every else f"{edge}(_v)"
    return [op, [f"SELECT {value} FROM ({text(inner)}) AS _q(_v)"]]


KEYWORDS = frozenset("SELECT WHERE AND OR NOT IN ON WHEN THEN ELSE CASE HAVING BY AS FROM BETWEEN LIKE IS DISTINCT ALL UNION RETURN LIMIT OFFSET DIV MOD XOR".split())
WHOLE = r"'^\\s*([-+]?[0-9]+)'"


def cast(value: str, kind: list) -> str:
    """CAST(value AS kind): MySQL's lenient conversions."""
    name, size = word(kind[0]), f"({text(kind[1])})" if len(kind) > 1 and isinstance(kind[1], list) else ""
    s = sql_of(T.time_text(F.expr(value))) if isinstance(value, Time) else f"cast({value} AS string)"
    if name in ("SIGNED", "UNSIGNED"):
        whole = f"CASE WHEN {value} IS NOT NULL THEN coalesce(try_cast(round(try_cast({s} AS decimal(38,10)), 0) AS bigint), try_cast(regexp_extract({s}, {WHOLE}, 1) AS bigint), 0) END"
        return whole if name == "SIGNED" else f"CASE WHEN ({whole}) < 0 THEN cast({whole} AS decimal(20,0)) + 18446744073709551616 ELSE cast({whole} AS decimal(20,0)) END"
    if name in ("CHAR", "NCHAR"):
        return f"left({s}, {size[1:-1]})" if size else s
    if name == "BINARY":
        return f"encode({f'left({s}, {size[1:-1]})' if size else s}, 'UTF-8')"
    if name == "DATETIME":
        return f"try_cast({value} AS timestamp_ntz)"
    if name == "DECIMAL":
        p, _, d = size[1:-1].partition(",")
        return sql_of(C.decimal(F.expr(value), int(p or 10), int(d or 0)))
    if name == "TIME":
        return value if isinstance(value, Time) else Time(sql_of(C.time(F.expr(value))))
    if name in ("DATE", "DOUBLE", "FLOAT", "JSON"):
        return s if name == "JSON" else f"try_cast({value} AS {name.lower()})"
    raise Unsupported(f"CAST AS {name}")


def left_side(out: list) -> str:
    """Takes the last operand: a literal, a name with its qualifiers, a call or what stands in parentheses."""
    expr = [out.pop()]
    if isinstance(expr[0], list) and out and isinstance(out[-1], str) and re.match(r"[A-Za-z_`]", out[-1]) and word(out[-1]) not in KEYWORDS:
        expr.insert(0, out.pop())
    if isinstance(expr[0], str) and STRING.fullmatch(expr[0]) and out and word(out[-1]) in ("DATE", "TIME", "TIMESTAMP", "TIMESTAMP_NTZ"):
        expr.insert(0, out.pop())
    while len(out) > 1 and out[-1] == ".":
        expr[:0] = [out[-2], out[-1]]
        del out[-2:]
    return text(expr)


def right_side(ts: list, i: int) -> tuple[str, int]:
    """The operand that starts at i, rewritten, and the place after it."""
    end = i
    while end < len(ts) and ts[end] in ("-", "+"):
        end += 1
    end += 1
    while end < len(ts) and (ts[end] == "." or ts[end - 1] == "." or isinstance(ts[end], list) and isinstance(ts[end - 1], str) and re.match(r"[A-Za-z_`]", ts[end - 1])):
        end += 1
    if end > len(ts):
        raise Unsupported("an operator without its right side")
    return text(rewrite(ts[i:end])), end


ARITHMETIC, COMPARED = ("+", "-", "*", "/", "%"), ("=", "<=>", "<>", "!=", "<", "<=", ">", ">=")


def numeric(t):
    """A quoted literal as the number that it begins with; any other token as it is."""
    if not isinstance(t, str) or not STRING.fullmatch(t):
        return t
    m = re.match(r"[ \t\n]*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", unquoted(t))
    return m[1] if m else "0"


def is_number(t) -> bool:
    return isinstance(t, str) and bool(re.fullmatch(r"\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|\.\d+", t))


def lenient(ts: list) -> list:
    """Quoted literals next to arithmetic operators, or compared with number literals, are numbers."""
    out = list(ts)
    for i, t in enumerate(ts):
        if not isinstance(t, str) or not 0 < i < len(ts) - 1:
            continue
        if (t in ARITHMETIC or word(t) in ("DIV", "MOD")) and word(ts[i + 1]) != "INTERVAL":
            out[i - 1], out[i + 1] = numeric(out[i - 1]), numeric(out[i + 1])
        elif t in COMPARED and (is_number(ts[i - 1]) or is_number(ts[i + 1])) and (i + 2 == len(ts) or ts[i + 2] not in ARITHMETIC) and (i == 1 or ts[i - 2] not in ARITHMETIC):
            out[i - 1], out[i + 1] = numeric(out[i - 1]), numeric(out[i + 1])
    return out


def rows_refused(ts: list) -> None:
    """Row constructors: (a, b) = (c, d), (a, b) IN (...)."""
    for i, t in enumerate(ts):
        if isinstance(t, list) and "," in t and word(t[0]) not in ("SELECT", "VALUES"):
            before, after = ts[i - 1] if i else None, ts[i + 1] if i + 1 < len(ts) else None
            called = isinstance(before, str) and re.match(r"[A-Za-z_`$]", before) and word(before) not in KEYWORDS - {"IN"}
            if not called and (before in COMPARED or after in COMPARED or word(after) in ("IN", "NOT")):
                raise Unsupported("row constructors")


BEFORE = frozenset("OR SELECT DISTINCT WHERE ON HAVING WHEN THEN ELSE CASE BY".split())
AFTER = frozenset("OR XOR GROUP ORDER HAVING LIMIT UNION THEN ELSE END AS FROM WHERE ASC DESC FOR LOCK".split())


def xors(ts: list) -> list:
    """a XOR b, which binds more than OR and less than AND."""
    while (at := next((i for i, t in enumerate(ts) if word(t) == "XOR"), None)) is not None:
        lo = next((i for i in range(at - 1, -1, -1) if ts[i] == "," or word(ts[i]) in BEFORE), -1) + 1
        hi = next((i for i in range(at + 1, len(ts)) if ts[i] == "," or word(ts[i]) in AFTER), len(ts))
        ts = [*ts[:lo], sql_of(P.xor(*(P.truth(F.expr(text(x))) for x in (ts[lo:at], ts[at + 1 : hi])))), *ts[hi:]]
    return ts


def rewrite(ts: list, parent: str = "") -> list:
    """One level of tokens, after the levels below it."""
    rows_refused(ts)
    ts = [rewrite(t, word(ts[i - 1]) if i else "") if isinstance(t, list) else t for i, t in enumerate(lenient(ts))]
    out: list = []
    i = 0
    while i < len(ts):
        t, w = ts[i], word(ts[i])
        after = ts[i + 1] if i + 1 < len(ts) else None
        if t == ":=":
            raise Unsupported("assignment to variables")
        if w == "INTO" and any(word(x) == "SELECT" for x in ts[:i]) and not any(word(x) in ("INSERT", "REPLACE") for x in ts[:i]):
            raise Unsupported("SELECT ... INTO")
        if (t in ("/", "%") or w in ("DIV", "MOD") and not (w == "MOD" and isinstance(after, list) and (not out or word(out[-1]) in KEYWORDS or out[-1] in (",", "+", "-", "*", "=", "<", ">", "<=", ">=", "<>")))) and out:
            # NULL for a zero divisor.
            a = left_side(out)
            b, end = right_side(ts, i + 1)
            out.append(f"try_divide({a}, {b})" if t == "/" else f"CASE WHEN {b} <> 0 THEN {a} div {b} END" if w == "DIV" else f"try_mod({a}, {b})")
            i = end - 1
        elif w == "CAST" and isinstance(after, list) and any(word(x) == "AS" for x in after):
            at = max(k for k, x in enumerate(after) if word(x) == "AS")
            out.append(cast(argument(after[:at]), after[at + 1 :]))
            i += 1
        elif w == "CONVERT" and isinstance(after, list):
            parts = split(after)
            if any(word(x) == "USING" for x in after):
                at = next(k for k, x in enumerate(after) if word(x) == "USING")
                out.append(sql_of(C.convert_using(F.expr(text(after[:at])), after[at + 1].strip("'\""))))
            else:
                out.append(cast(argument(parts[0]), parts[1]))
            i += 1
        elif t in ("||", "&&"):
            out.append("OR" if t == "||" else "AND")
        elif t == "!":
            out.append("NOT")
        elif w == "STRAIGHT_JOIN":
            out.append("JOIN")
        elif w in ("ROLLUP",) and word(out[-1] if out else "") == "WITH":
            raise Unsupported("WITH ROLLUP")
        elif w == "FOR" and word(after) in ("UPDATE", "SHARE") or w == "LOCK" and word(after) == "IN":
            break
        elif t in ("->", "->>") and out:
            doc = out.pop()
            while len(out) > 1 and out[-1] == ".":
                dot, left = out.pop(), out.pop()
                doc = f"{left}{dot}{doc}"
            found = json_extract([doc, after])
            out.append(sql_of(J.json_unquote(F.expr(found))) if t == "->>" else found)
            i += 1
        elif t in ("=", "<>", "!=", "<", "<=", ">", ">=") and word(after) in ("ANY", "SOME", "ALL") and i + 2 < len(ts) and isinstance(ts[i + 2], list):
            if t == "=" and word(after) == "ALL" or t in ("<>", "!=") and word(after) != "ALL":
                out.append(all_equal(left_side(out), ts[i + 2], word(after) == "ALL"))
            else:
                out += quantifier(t, "ALL" if word(after) == "ALL" else "ANY", ts[i + 2])
            i += 2
        elif t in ("+", "-") and word(after) == "INTERVAL" and out:
            amount, unit, end = interval_at(ts, i + 1)
            out.append(moved(left_side(out), amount, unit, t == "-"))
            i = end - 1
        elif w in ("CHAR", "NCHAR", "BINARY") and isinstance(after, list) and out and (word(out[-1]) == "AS" and parent == "CAST" or out[-1] == "," and parent == "CONVERT"):
            out += [t, after]  # a type
            i += 1
        elif w == "LIMIT" and i + 3 < len(ts) and ts[i + 2] == ",":
            out += ["LIMIT", ts[i + 3], "OFFSET", after]
            i += 3
        elif isinstance(after, list) and isinstance(t, str) and re.match(r"[A-Za-z_]", t) and (not out or out[-1] != "."):
            if w == "GROUP_CONCAT":
                out.append(group_concat(after))
                i += 1
            elif (made := special(w, after)) is not None:
                out.append(made)
                i += 1
            elif w in FUNCTIONS and not any(word(x) in ("FROM", "DISTINCT") for x in after) and word(out[-1] if out else "") not in ("TABLE", "INTO"):
                args = [argument(a) for a in split(after)]
                out.append(OF_TIMES[w](args[0]) if args and isinstance(args[0], Time) and w in OF_TIMES else FUNCTIONS[w](args))
                i += 1
            else:
                out.append(t)
        else:
            out.append(t)
        i += 1
    return xors(out)


def substituted(ts: list, variables: dict) -> list:
    """@name and @@name as literals; a variable that isn't set is NULL."""
    out, i = [], 0
    while i < len(ts):
        t = ts[i]
        if isinstance(t, list):
            out.append(substituted(t, variables))
        elif t == "@" and i + 1 < len(ts):
            i += 2 if ts[i + 1] == "@" and i + 2 < len(ts) else 1
            if i + 1 < len(ts) and ts[i + 1] == ":=":
                raise Unsupported("assignment to variables")
            value = variables.get(ts[i])
            out.append("NULL" if value is None else quoted(value) if isinstance(value, str) else str(value))
        else:
            out.append(t)
        i += 1
    return out


def named(ts: list, count: int = 0) -> tuple[list, int]:
    """Positional parameters (?) with names in their order, as rewriting may repeat or move them."""
    out = []
    for t in ts:
        if isinstance(t, list):
            t, count = named(t, count)
        elif t == "?":
            t, count = f":_p{count}", count + 1
        out.append(t)
    return out, count


def translate(sql: str, variables: dict | None = None) -> str:
    return text(rewrite(substituted(named(tokens(sql))[0], variables or {})))


def run(spark: SparkSession, sql: str, variables: dict | None = None, values: list | tuple = (), **parameters) -> DataFrame:
    """A statement, with user and system variables; if it is prepared, with values in the order of its ? or named ones (:name)."""
    ts, count = named(tokens(sql))
    if count != len(values):
        raise Unsupported(f"{count} parameters, {len(values)} values")
    made = text(rewrite(substituted(ts, variables or {})))
    args = parameters | {f"_p{i}": v for i, v in enumerate(values)}
    return spark.sql(made, args=args) if args else spark.sql(made)
