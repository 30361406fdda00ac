"""A query a function: expressions over whole tables, and the same in SQL.

Inputs come from a few bases, whose expressions read the same in both dialects; they make NULLs, negative numbers and zeros, which the tables lack.
"""

from __future__ import annotations

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

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BASES = {
    "str": ("part", ["p_partkey AS k", "nullif(p_name, 'red widget') AS s", "p_brand AS t", "nullif(p_size, 10) AS n", "p_size - 25 AS i"]),
    "num": ("part", ["p_partkey AS k", "nullif(p_size, 10) AS n", "p_size - 25 AS i", "p_retailprice - 950 AS x", "p_retailprice AS y", "p_brand AS t"]),
    "day": ("orders", ["o_orderkey AS k", "nullif(o_orderdate, timestamp '1998-10-03 00:00:00') AS d", "o_custkey AS c", "cast(o_orderkey % 40 AS int) - 20 AS m", "o_totalprice AS p"]),
    "ev": ("events", ["event_id AS k", "ts AS d", "nullif(user_id, 7) AS u", "props AS j", "value AS v", "event_type AS e"]),
}

#: How a column of each kind is cast, in Spark and in SQL.
KINDS = {
    "l": (lambda c: c.cast("long"), "CAST({} AS BIGINT)"),
    "d": (lambda c: F.round(c.cast("double"), 6), "round(CAST({} AS DOUBLE), 6)"),
    "s": (lambda c: c.cast("string"), "CAST({} AS VARCHAR)"),
    "b": (lambda c: c.cast("boolean"), "CAST({} AS BOOLEAN)"),
    "t": (lambda c: c.cast("timestamp_ntz"), "CAST({} AS TIMESTAMP)"),
    "D": (lambda c: c.cast("date").cast("string"), "CAST(CAST({} AS DATE) AS VARCHAR)"),
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, exprs = BASES[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*exprs)


def base_sql(name: str) -> str:
    table, exprs = BASES[name]
    return f"(SELECT {', '.join(exprs)} FROM {table})"


def fn(name: str, of: str, **columns: tuple[str, Column, str | None]) -> None:
    """Registers fn_<name>: the key and the columns (kind, Spark column, SQL); without SQL for one, the query has no oracle."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return base(spark, sf_dir, of).select("k", *[KINDS[kind][0](made()).alias(alias) for alias, (kind, made, _) in columns.items()])

    QUERIES[f"fn_{name}"] = query
    if all(sql for _, _, sql in columns.values()):
        ORACLE_SQL[f"fn_{name}"] = f"SELECT k, {', '.join(KINDS[kind][1].format(sql) + ' AS ' + alias for alias, (kind, _, sql) in columns.items())} FROM {base_sql(of)}"


s, t, n, i, x, y, d, m, c, p, u, j, v, e, k = (lambda name=name: F.col(name) for name in "s t n i x y d m c p u j v e k".split())

# --- strings -------------------------------------------------------------------------------------------------------

fn("str_ascii", "str", r=("l", lambda: S.ascii_(s()), "ascii(s)"))
fn("str_bit_length", "str", r=("l", lambda: S.bit_length(s()), "bit_length(s)"))
fn("str_char", "str", r=("s", lambda: S.char(77, F.abs(i()) % 26 + 65, None), "'M' || chr((abs(i) % 26 + 65)::INT)"))
fn("str_char_length", "str", r=("l", lambda: S.char_length(s()), "length(s)"))
fn("str_concat", "str", r=("s", lambda: S.concat(s(), "/", t()), "s || '/' || t"))
fn("str_concat_ws", "str", r=("s", lambda: S.concat_ws("-", s(), t(), n()), "concat_ws('-', s, t, n)"))
fn("str_elt", "str", r=("s", lambda: S.elt(n() % 5, s(), t(), "z"), "CASE n % 5 WHEN 1 THEN s WHEN 2 THEN t WHEN 3 THEN 'z' END"))
fn("str_field", "str", r=("l", lambda: S.field(t(), "Brand#3", "Brand#17", "Brand#4"), "CASE t WHEN 'Brand#3' THEN 1 WHEN 'Brand#17' THEN 2 WHEN 'Brand#4' THEN 3 ELSE 0 END"))
fn("str_find_in_set", "str", r=("l", lambda: S.find_in_set(t(), "Brand#3,Brand#17,Brand#4"), "CASE t WHEN 'Brand#3' THEN 1 WHEN 'Brand#17' THEN 2 WHEN 'Brand#4' THEN 3 ELSE 0 END"))
fn("str_format", "num", r=("s", lambda: S.format_number(y() * 1000, 2), "format('{:,.2f}', y * 1000)"))
fn("str_hex", "str", r=("s", lambda: S.hex_(s()), "hex(s)"), q=("s", lambda: S.hex_(n(), numeric=True), "hex(n)"))
fn("str_insert", "str", r=("s", lambda: S.insert(s(), 3, 2, "XX"), "substr(s, 1, 2) || 'XX' || substr(s, 5)"), q=("s", lambda: S.insert(s(), i(), 3, "-"), "CASE WHEN i < 1 OR i > length(s) THEN s ELSE substr(s, 1, i - 1) || '-' || substr(s, i + 3) END"))
fn("str_instr", "str", r=("l", lambda: S.instr(s(), "r"), "instr(s, 'r')"))
fn("str_left", "str", r=("s", lambda: S.left(s(), 4), "left(s, 4)"), q=("s", lambda: S.left(s(), i()), "CASE WHEN i <= 0 THEN left(s, 0) ELSE left(s, i) END"))
fn("str_length", "str", r=("l", lambda: S.length(s()), "strlen(s)"))
fn("str_locate", "str", r=("l", lambda: S.locate("e", s(), 3), "CASE WHEN instr(substr(s, 3), 'e') > 0 THEN instr(substr(s, 3), 'e') + 2 WHEN s IS NOT NULL THEN 0 END"))
fn("str_lower", "str", r=("s", lambda: S.lower(t()), "lower(t)"))
fn("str_lpad", "str", r=("s", lambda: S.lpad(s(), 14, "*-"), "lpad(s, 14, '*-')"), q=("s", lambda: S.lpad(s(), i(), "ab"), "CASE WHEN i >= 0 THEN lpad(s, i, 'ab') END"))
fn("str_rpad", "str", r=("s", lambda: S.rpad(s(), 14, "*-"), "rpad(s, 14, '*-')"), q=("s", lambda: S.rpad(s(), 30, ""), "CASE WHEN length(s) >= 30 THEN left(s, 30) END"))
fn("str_ltrim", "str", r=("s", lambda: S.ltrim(S.concat("  ", s(), " ")), "ltrim('  ' || s || ' ')"))
fn("str_rtrim", "str", r=("s", lambda: S.rtrim(S.concat(" ", s(), "  ")), "rtrim(' ' || s || '  ')"))
fn("str_make_set", "str", r=("s", lambda: S.make_set(n(), "a", t(), None, "d"), "CASE WHEN n IS NOT NULL THEN concat_ws(',', CASE WHEN n & 1 <> 0 THEN 'a' END, CASE WHEN n & 2 <> 0 THEN t END, CASE WHEN n & 8 <> 0 THEN 'd' END) END"))
fn("str_ord", "str", r=("l", lambda: S.ord_(s()), "ascii(s)"))
fn("str_quote", "str", r=("s", lambda: S.quote(S.concat(s(), "'s")), "coalesce('''' || s || chr(92) || '''s''', 'NULL')"))
fn("str_repeat", "str", r=("s", lambda: S.repeat(t(), i() % 4), "repeat(t, greatest(i % 4, 0))"))
fn("str_replace", "str", r=("s", lambda: S.replace(s(), "r", "RR"), "replace(s, 'r', 'RR')"))
fn("str_reverse", "str", r=("s", lambda: S.reverse(s()), "reverse(s)"))
fn("str_right", "str", r=("s", lambda: S.right(s(), 4), "right(s, 4)"))
_codes = "translate(substr(upper(replace(s, ' ', '')), 2), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
_runs = f"(translate(left(upper(s), 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202') || replace({_codes}, '0', ''))"
for _ in range(4):
    for _g in "123456":
        _runs = f"replace({_runs}, '{_g * 2}', '{_g}')"
fn("str_soundex", "str", r=("s", lambda: S.soundex(s()), f"rpad(upper(left(s, 1)) || substr({_runs}, 2), greatest(4, length({_runs}))::INT, '0')"))
fn("str_space", "str", r=("s", lambda: S.concat("[", S.space(i() % 4), "]"), "'[' || repeat(' ', greatest(i % 4, 0)) || ']'"))
fn("str_substring", "str", r=("s", lambda: S.substring(s(), 2, 3), "substr(s, 2, 3)"), q=("s", lambda: S.substring(s(), -3), "CASE WHEN length(s) >= 3 THEN right(s, 3) WHEN s IS NOT NULL THEN '' END"), z=("s", lambda: S.substring(s(), 0, 2), "left(s, 0)"))
fn("str_substring_index", "str", r=("s", lambda: S.substring_index(s(), " ", 1), "split_part(s, ' ', 1)"), q=("s", lambda: S.substring_index(s(), " ", -1), "split_part(s, ' ', -1)"))
fn("str_trim", "str", r=("s", lambda: S.trim(S.concat("  ", s(), "  ")), "trim('  ' || s || '  ')"), q=("s", lambda: S.trim(s(), "r"), "regexp_replace(regexp_replace(s, '^(r)+', ''), '(r)+$', '')"), z=("s", lambda: S.trim(s(), "re", "leading"), "regexp_replace(s, '^(re)+', '')"))
fn("str_unhex", "str", r=("s", lambda: S.unhex(S.hex_(s())), "decode(unhex(hex(s)))"), q=("s", lambda: S.unhex(t()), "CASE WHEN regexp_full_match(t, '[0-9A-Fa-f]*') THEN t END"))
fn("str_upper", "str", r=("s", lambda: S.upper(s()), "upper(s)"))
fn("str_uuid", "str", r=("l", lambda: F.length(S.uuid()), "36"))

# --- JSON ----------------------------------------------------------------------------------------------------------

fn("json_extract", "ev", r=("s", lambda: J.json_extract(j(), "$.k"), "json_extract(j, '$.k')"), q=("s", lambda: J.json_extract(j(), "$.none"), "json_extract(j, '$.none')"))
fn("json_extract_paths", "ev", r=("s", lambda: J.json_extract(j(), "$.k", "$.none"), "'[' || json_extract_string(j, '$.k') || ']'"), q=("s", lambda: J.json_extract(j(), "$.*"), "'[' || json_extract_string(j, '$.k') || ']'"))
fn("json_extract_deep", "ev", r=("s", lambda: J.json_extract(F.concat(F.lit('{"a": [1, '), j(), F.lit("]}")), "$**.k"), "'[' || json_extract_string(j, '$.k') || ']'"), q=("s", lambda: J.json_extract(F.concat(F.lit('{"a": [1, '), j(), F.lit("]}")), "$.a[0]"), "'1'"))
fn("json_unquote", "ev", r=("s", lambda: J.json_unquote(F.concat(F.lit('"'), e(), F.lit('"'))), "e"), q=("s", lambda: J.json_value(j(), "$.k"), "json_extract_string(j, '$.k')"))

# --- math and bits -------------------------------------------------------------------------------------------------

fn("math_abs", "num", r=("d", lambda: M.abs_(x()), "abs(x)"), q=("l", lambda: M.abs_(i()), "abs(i)"))
fn("math_acos", "num", r=("d", lambda: M.acos(x() / 20), "CASE WHEN abs(x / 20) <= 1 THEN acos(x / 20) END"))
fn("math_asin", "num", r=("d", lambda: M.asin(x() / 20), "CASE WHEN abs(x / 20) <= 1 THEN asin(x / 20) END"))
fn("math_atan", "num", r=("d", lambda: M.atan(x()), "atan(x)"), q=("d", lambda: M.atan(x(), i()), "atan2(x, i)"))
fn("math_conv", "num", r=("s", lambda: M.conv(n(), 10, 16), "hex(n)"), q=("s", lambda: M.bin_(n()), "CASE WHEN n = 0 THEN '0' ELSE ltrim(bin(n), '0') END"), z=("s", lambda: M.conv(n(), 10, 99), "NULL"))
fn("math_ceil", "num", r=("l", lambda: M.ceil(x()), "ceil(x)"))
fn("math_cos", "num", r=("d", lambda: M.cos(x()), "cos(x)"))
fn("math_cot", "num", r=("d", lambda: M.cot(i()), "CASE WHEN i <> 0 THEN 1 / tan(i) END"))
#: Bit by bit, as the polynomial has it.
CRC32_SQL = "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: list_reduce(list_prepend(xor(h, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, _: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"
fn("math_crc32", "num", r=("l", lambda: M.crc32(t()), CRC32_SQL.format("t")))
fn("math_degrees", "num", r=("d", lambda: M.degrees(x()), "degrees(x)"))
fn("math_exp", "num", r=("d", lambda: M.exp(x() / 20), "exp(x / 20)"))
fn("math_floor", "num", r=("l", lambda: M.floor(x()), "floor(x)"))
fn("math_ln", "num", r=("d", lambda: M.ln(x()), "CASE WHEN x > 0 THEN ln(x) END"))
fn("math_log", "num", r=("d", lambda: M.log(n(), y()), "CASE WHEN n > 0 AND n <> 1 THEN ln(y) / ln(n) END"), q=("d", lambda: M.log(x()), "CASE WHEN x > 0 THEN ln(x) END"))
fn("math_log10", "num", r=("d", lambda: M.log10(x()), "CASE WHEN x > 0 THEN log10(x) END"))
fn("math_log2", "num", r=("d", lambda: M.log2(x()), "CASE WHEN x > 0 THEN log2(x) END"))
fn("math_md5", "num", r=("s", lambda: M.md5(t()), "md5(t)"))
fn("math_pi", "num", r=("d", M.pi, "pi()"))
fn("math_pow", "num", r=("d", lambda: M.pow_(i(), 2), "pow(i, 2)"))
fn("math_radians", "num", r=("d", lambda: M.radians(x()), "radians(x)"))
fn("math_rand", "num", r=("b", lambda: (M.rand(7) >= 0) & (M.rand(7) < 1), "TRUE"))
fn("math_round", "num", r=("d", lambda: M.round_(x().cast("decimal(18,4)"), 1), "round(x::DECIMAL(18,4), 1)"), q=("l", lambda: M.round_(i() * 7, -1), "sign(i) * floor((abs(i) * 7 + 5) / 10) * 10"))
fn("math_sign", "num", r=("l", lambda: M.sign(i()), "sign(i)"))
fn("math_sin", "num", r=("d", lambda: M.sin(x()), "sin(x)"))
fn("math_sqrt", "num", r=("d", lambda: M.sqrt(x()), "CASE WHEN x >= 0 THEN sqrt(x) END"))
fn("math_tan", "num", r=("d", lambda: M.tan(i()), "tan(i)"))
fn("math_truncate", "num", r=("d", lambda: M.truncate(x(), 1), "trunc(x::DECIMAL(18,4) * 10) / 10"), q=("d", lambda: M.truncate(y(), -2), "trunc(y / 100) * 100"))
fn("op_plus", "num", r=("d", lambda: M.plus(n(), x()), "n + x"))
fn("op_minus", "num", r=("l", lambda: M.minus(n(), i()), "n - i"))
fn("op_times", "num", r=("d", lambda: M.times(n(), x()), "n * x"))
fn("op_divide", "num", r=("d", lambda: M.divide(y(), i()), "CASE WHEN i <> 0 THEN y / i END"))
fn("op_div", "num", r=("l", lambda: M.div(n() * 100, i()), "CASE WHEN i <> 0 THEN trunc((n * 100)::DOUBLE / i) END"))
fn("op_mod", "num", r=("l", lambda: M.mod(n() * 100, i()), "CASE WHEN i <> 0 THEN (n * 100) % i END"))
fn("op_neg", "num", r=("l", lambda: M.neg(i()), "-i"))
_u = "CASE WHEN ({0}) < 0 THEN ({0})::HUGEINT + 18446744073709551616 ELSE ({0})::HUGEINT END"
fn("bit_and", "num", r=("s", lambda: M.bit_and(i(), n()), _u.format("i::BIGINT & n::BIGINT")))
fn("bit_or", "num", r=("s", lambda: M.bit_or(i(), n()), _u.format("i::BIGINT | n::BIGINT")))
fn("bit_xor", "num", r=("s", lambda: M.bit_xor(i(), n()), _u.format("xor(i::BIGINT, n::BIGINT)")))
fn("bit_not", "num", r=("s", lambda: M.bit_not(n()), _u.format("~(n::BIGINT)")))
fn("bit_shift_left", "num", r=("s", lambda: M.shift_left(n(), 3), "n::HUGEINT * 8"))
fn("bit_shift_right", "num", r=("s", lambda: M.shift_right(n(), 2), "n::HUGEINT // 4"))
fn("bit_count", "num", r=("l", lambda: M.bit_count(n()), "bit_count(n)"))

# --- dates and times -----------------------------------------------------------------------------------------------

_sod = "(hour(d) * 3600 + minute(d) * 60 + second(d))"
_hms = "strftime(d, '%H:%M:%S')"
fn("time_addtime", "ev", r=("t", lambda: T.addtime(d(), T.maketime(1, 30, 15)), "d + INTERVAL '1 hour 30 minutes 15 seconds'"))
fn("time_subtime", "ev", r=("t", lambda: T.subtime(d(), T.maketime(1, 30, 15)), "d - INTERVAL '1 hour 30 minutes 15 seconds'"))
fn("time_convert_tz", "ev", r=("t", lambda: T.convert_tz(d(), "UTC", "+02:00"), "d + INTERVAL 2 HOUR"))
fn("time_now", "ev", r=("b", lambda: (T.now() == T.sysdate()) & (T.curdate() == F.to_date(T.now())), "TRUE"), q=("b", lambda: T.utc_date() == F.to_date(T.utc_timestamp()), "TRUE"), z=("l", lambda: F.length(T.curtime()) + F.length(T.utc_time()), "16"))
fn("time_date", "ev", r=("D", lambda: T.date(d()), "d"))
fn("time_datediff", "day", r=("l", lambda: T.datediff(d(), F.lit("1996-02-29").cast("date")), "date_diff('day', DATE '1996-02-29', d)"))
_w0, _w1 = "CAST(strftime(d, '%U') AS INT)", "(CASE WHEN isoyear(d) = year(d) THEN weekofyear(d) WHEN isoyear(d) < year(d) THEN 0 WHEN isoyear(d) > year(d) THEN 53 END)"
fn("time_date_format", "ev", r=("s", lambda: T.date_format(d(), "%Y-%m-%d %H:%i:%s.%f"), "strftime(d, '%Y-%m-%d %H:%M:%S.%f')"), q=("s", lambda: T.date_format(d(), "%W %M %j %p at %h"), "strftime(d, '%A %B %j %p at %I')"), z=("s", lambda: T.date_format(d(), "%U/%u %w %y%%"), f"lpad({_w0}::VARCHAR, 2, '0') || '/' || lpad({_w1}::VARCHAR, 2, '0') || ' ' || dayofweek(d) || strftime(d, ' %y') || '%'"))
fn("time_date_format_day", "day", r=("s", lambda: T.date_format(d(), "%D"), "day(d) || CASE WHEN day(d) BETWEEN 11 AND 13 THEN 'th' WHEN day(d) % 10 = 1 THEN 'st' WHEN day(d) % 10 = 2 THEN 'nd' WHEN day(d) % 10 = 3 THEN 'rd' ELSE 'th' END"), q=("s", lambda: T.date_format(d(), "%x-%v"), "isoyear(d) || '-' || lpad(weekofyear(d)::VARCHAR, 2, '0')"))
fn("time_time_format", "ev", r=("s", lambda: T.time_format(d(), "%Y %H.%i.%s"), "'0000 ' || strftime(d, '%H.%M.%S')"))
fn("time_get_format", "ev", r=("s", lambda: T.get_format("DATE", "EUR"), "'%d.%m.%Y'"), q=("s", lambda: T.date_format(d(), T.FORMATS["DATETIME", "USA"]), "strftime(d, '%Y-%m-%d %H.%M.%S')"))
fn("time_dayname", "day", r=("s", lambda: T.dayname(d()), "dayname(d)"))
fn("time_monthname", "day", r=("s", lambda: T.monthname(d()), "monthname(d)"))
fn("time_dayofmonth", "day", r=("l", lambda: T.dayofmonth(d()), "day(d)"))
fn("time_dayofweek", "day", r=("l", lambda: T.dayofweek(d()), "dayofweek(d) + 1"))
fn("time_dayofyear", "day", r=("l", lambda: T.dayofyear(d()), "dayofyear(d)"))
fn("time_from_days", "day", r=("D", lambda: T.from_days(F.lit(728000) + c()), "DATE '0001-01-01' + CAST(728000 + c - 366 AS INT)"))
fn("time_from_unixtime", "day", r=("t", lambda: T.from_unixtime(F.lit(800000000) + c() * 1000), "to_timestamp(800000000 + c * 1000) AT TIME ZONE 'UTC'"), q=("s", lambda: T.from_unixtime(F.lit(800000000) + c(), "%H:%i:%s"), "strftime(make_timestamp((800000000 + c) * 1000000), '%H:%M:%S')"))
fn("time_hour", "ev", r=("l", lambda: T.hour(d()), "hour(d)"))
fn("time_minute", "ev", r=("l", lambda: T.minute(d()), "minute(d)"))
fn("time_second", "ev", r=("l", lambda: T.second(d()), "second(d)"))
fn("time_microsecond", "ev", r=("l", lambda: T.microsecond(d()), "microsecond(d) % 1000000"))
fn("time_last_day", "day", r=("D", lambda: T.last_day(d()), "last_day(d)"))
fn("time_makedate", "day", r=("D", lambda: T.makedate(T.year(d()), m() * 20), "CASE WHEN m > 0 THEN make_date(year(d), 1, 1) + m * 20 - 1 END"))
fn("time_maketime", "day", r=("s", lambda: T.time_text(T.maketime(m(), F.abs(m()), 5)), "CASE WHEN m < 0 THEN '-' ELSE '' END || lpad(abs(m)::VARCHAR, 2, '0') || ':' || lpad(abs(m)::VARCHAR, 2, '0') || ':05'"), q=("s", lambda: T.time_text(T.maketime(1, m() * 10, 0)), "CASE WHEN m * 10 BETWEEN 0 AND 59 THEN '01:' || lpad((m * 10)::VARCHAR, 2, '0') || ':00' END"))
fn("time_month", "day", r=("l", lambda: T.month(d()), "month(d)"))
fn("time_quarter", "day", r=("l", lambda: T.quarter(d()), "quarter(d)"))
fn("time_year", "day", r=("l", lambda: T.year(d()), "year(d)"))
fn("time_period_add", "day", r=("l", lambda: T.period_add(T.year(d()) * 100 + T.month(d()), m()), "CAST(strftime(d + to_months(m), '%Y%m') AS INT)"))
fn("time_period_diff", "day", r=("l", lambda: T.period_diff(T.year(d()) * 100 + T.month(d()), 199602), "(year(d) - 1996) * 12 + month(d) - 2"))
fn("time_sec_to_time", "day", r=("s", lambda: T.time_text(T.sec_to_time(m() * 4000)), "CASE WHEN m < 0 THEN '-' ELSE '' END || lpad((abs(m) * 4000 // 3600)::VARCHAR, 2, '0') || ':' || lpad((abs(m) * 4000 // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((abs(m) * 4000 % 60)::VARCHAR, 2, '0')"), q=("s", lambda: T.time_text(T.sec_to_time(4000000)), "'838:59:59'"))
fn("time_time_to_sec", "ev", r=("l", lambda: T.time_to_sec(d()), _sod))
fn("time_str_to_date", "ev", r=("D", lambda: T.str_to_date(F.date_format(d(), "dd/MM/yyyy"), "%d/%m/%Y"), "d"), q=("t", lambda: T.str_to_date(F.date_format(d(), "yyyy-MM-dd HH:mm:ss"), "%Y-%m-%d %H:%i:%s"), "date_trunc('second', d)"), z=("D", lambda: T.str_to_date(e(), "%d/%m/%Y"), "NULL"))
fn("time_time", "ev", r=("s", lambda: T.time_text(T.time(d())), _hms))
fn("time_timediff", "ev", r=("s", lambda: T.time_text(T.timediff(d(), F.date_trunc("day", d()))), _hms))
fn("time_timestampdiff", "day", r=("l", lambda: T.timestampdiff("MONTH", F.lit("1996-02-15 00:00:00").cast("timestamp"), d()), "date_sub('month', TIMESTAMP '1996-02-15 00:00:00', d)"), q=("l", lambda: T.timestampdiff("DAY", F.lit("1996-02-15 00:00:00").cast("timestamp"), d()), "date_sub('day', TIMESTAMP '1996-02-15 00:00:00', d)"), z=("l", lambda: T.timestampdiff("HOUR", F.lit("1996-02-15 00:00:00").cast("timestamp"), d()), "date_sub('hour', TIMESTAMP '1996-02-15 00:00:00', d)"))
fn("time_to_days", "day", r=("l", lambda: T.to_days(d()), "date_diff('day', DATE '0001-01-01', d) + 366"))
fn("time_to_seconds", "ev", r=("l", lambda: T.to_seconds(d()), f"(date_diff('day', DATE '0001-01-01', d::DATE) + 366) * 86400 + {_sod}"))
fn("time_unix_timestamp", "ev", r=("l", lambda: T.unix_timestamp(d()), "floor(epoch(d))"))
fn("time_week", "day", a=("l", lambda: T.week(d(), 0), _w0), b=("l", lambda: T.week(d(), 1), _w1), g=("l", lambda: T.week(d(), 3), "weekofyear(d)"), h=("l", lambda: T.week(d(), 5), "CAST(strftime(d, '%W') AS INT)"))
fn("time_weekday", "day", r=("l", lambda: T.weekday(d()), "isodow(d) - 1"))
fn("time_weekofyear", "day", r=("l", lambda: T.weekofyear(d()), "weekofyear(d)"))
fn("time_yearweek", "day", r=("l", lambda: T.yearweek(d(), 3), "yearweek(d)"), q=("l", lambda: T.yearweek(d(), 0), "CASE WHEN CAST(strftime(d, '%U') AS INT) > 0 THEN year(d) * 100 + CAST(strftime(d, '%U') AS INT) ELSE (year(d) - 1) * 100 + CAST(strftime(make_date(year(d) - 1, 12, 31), '%U') AS INT) END"))
fn("time_extract", "ev", a=("l", lambda: T.extract("YEAR_MONTH", d()), "year(d) * 100 + month(d)"), b=("l", lambda: T.extract("DAY_SECOND", d()), "((day(d) * 100 + hour(d)) * 100 + minute(d)) * 100 + second(d)"), g=("l", lambda: T.extract("HOUR_MICROSECOND", d()), "((hour(d) * 100 + minute(d)) * 100 + second(d)) * 1000000 + microsecond(d) % 1000000"), h=("l", lambda: T.extract("WEEK", d()), _w0))
fn("time_date_add", "day", a=("t", lambda: T.date_add(d(), m(), "MONTH"), "d + to_months(m)"), b=("t", lambda: T.date_add(d(), m(), "WEEK"), "d + to_days(m * 7)"), g=("t", lambda: T.date_sub(d(), m(), "HOUR"), "d - to_hours(m)"), h=("t", lambda: T.date_add(d(), "1:30", "MINUTE_SECOND"), "d + INTERVAL 90 SECOND"))

# --- comparison, control, logic -------------------------------------------------------------------------------------

fn("cmp_eq_ne", "num", a=("b", lambda: P.eq(n(), 7), "n = 7"), b=("b", lambda: P.ne(n(), 7), "n <> 7"))
fn("cmp_order", "num", a=("b", lambda: P.gt(n(), i()), "n > i"), b=("b", lambda: P.ge(n(), 20), "n >= 20"), g=("b", lambda: P.lt(n(), 20), "n < 20"), h=("b", lambda: P.le(n(), 20), "n <= 20"))
fn("cmp_in", "num", a=("b", lambda: P.in_(n(), 1, 2, 3), "n IN (1, 2, 3)"), b=("b", lambda: P.in_(i(), 1, None), "i IN (1, NULL)"))
fn("cmp_like", "str", a=("b", lambda: P.like(s(), "re%g_t%"), "s LIKE 're%g_t%'"), b=("b", lambda: P.like(F.concat(t(), F.lit("%")), "Brand#1_!%", "!"), "(t || '%') LIKE 'Brand#1_!%' ESCAPE '!'"))
fn("cmp_regexp", "str", r=("b", lambda: P.regexp(s(), "^(red|blue) [a-r]"), "regexp_matches(s, '^(red|blue) [a-r]')"), q=("b", lambda: P.not_(P.regexp(s(), "g$")), "NOT regexp_matches(s, 'g$')"))
fn("cmp_is", "num", a=("b", lambda: P.is_null(n()), "n IS NULL"), b=("b", lambda: P.is_not_null(n()), "n IS NOT NULL"), g=("b", lambda: P.is_true(n()), "coalesce(n <> 0, FALSE)"), h=("b", lambda: P.is_false(i()), "coalesce(i = 0, FALSE)"))
fn("cmp_is_not", "num", a=("b", lambda: P.is_not_true(n()), "NOT coalesce(n <> 0, FALSE)"), b=("b", lambda: P.is_not_false(n()), "NOT coalesce(n = 0, FALSE)"))
fn("cmp_coalesce", "num", r=("l", lambda: P.coalesce(n(), i(), 0), "coalesce(n, i, 0)"), q=("l", lambda: P.ifnull(n(), -1), "ifnull(n, -1)"), z=("l", lambda: P.nullif(i(), 0), "nullif(i, 0)"))
fn("cmp_greatest", "num", r=("l", lambda: P.greatest(n(), i(), 7), "CASE WHEN n IS NOT NULL THEN greatest(n, i, 7) END"))
fn("cmp_least", "num", r=("l", lambda: P.least(n(), i(), 7), "CASE WHEN n IS NOT NULL THEN least(n, i, 7) END"))
fn("cmp_interval", "num", r=("l", lambda: P.interval(n(), 5, 15, 25, 45), "CASE WHEN n IS NULL THEN -1 ELSE (n >= 5)::INT + (n >= 15)::INT + (n >= 25)::INT + (n >= 45)::INT END"))
fn("cmp_strcmp", "str", r=("l", lambda: P.strcmp(s(), "green"), "CASE WHEN s < 'green' THEN -1 WHEN s > 'green' THEN 1 WHEN s = 'green' THEN 0 END"))
fn("cmp_between", "num", r=("b", lambda: P.between(n(), 10, 20), "n BETWEEN 10 AND 20"), q=("b", lambda: P.not_(P.between(i(), n(), 5)), "i NOT BETWEEN n AND 5"))
fn("cmp_null_safe", "num", r=("b", lambda: P.null_safe_eq(n(), None), "n IS NOT DISTINCT FROM NULL"), q=("b", lambda: P.null_safe_eq(n(), i() + 25), "n IS NOT DISTINCT FROM (i + 25)"))
fn("cmp_loose", "str", r=("b", lambda: P.loose_eq(F.concat(n().cast("string"), F.lit("abc")), n()), "CASE WHEN n IS NOT NULL THEN TRUE END"), q=("b", lambda: P.loose_eq(t(), 0), "TRUE"))
fn("ctl_case", "num", r=("s", lambda: P.case((n() < 10, "low"), (n() < 30, "mid"), otherwise="high"), "CASE WHEN n < 10 THEN 'low' WHEN n < 30 THEN 'mid' ELSE 'high' END"), q=("s", lambda: P.case((1, "one"), (2, "two"), of=n()), "CASE n WHEN 1 THEN 'one' WHEN 2 THEN 'two' END"))
fn("ctl_if", "num", r=("l", lambda: P.if_(n() > 20, n(), -1), "CASE WHEN n > 20 THEN n ELSE -1 END"))
fn("logic_and_or", "num", a=("b", lambda: P.and_(n() > 5, i() > 0), "n > 5 AND i > 0"), b=("b", lambda: P.or_(n() > 5, i() > 0), "n > 5 OR i > 0"))
fn("logic_not_xor", "num", a=("b", lambda: P.not_(n() > 5), "NOT n > 5"), b=("b", lambda: P.xor(n() > 5, i() > 0), "(n > 5) <> (i > 0)"))

# --- casts ---------------------------------------------------------------------------------------------------------

fn("cast_char", "num", r=("s", lambda: C.char(t(), 6), "left(t, 6)"), q=("s", lambda: C.nchar(n()), "n"))
fn("cast_binary", "num", r=("s", lambda: F.hex(C.binary(t(), 5)), "hex(left(t, 5))"))
fn("cast_signed", "str", r=("l", lambda: C.signed(F.concat(i().cast("string"), F.lit("abc"))), "i"), q=("l", lambda: C.signed(t()), "0"), z=("l", lambda: C.signed(n() + F.lit(0.5).cast("decimal(3,1)")), "n + 1"))
fn("cast_unsigned", "num", r=("s", lambda: C.unsigned_(i()), _u.format("i::BIGINT")))
fn("cast_decimal", "num", r=("d", lambda: C.decimal(y(), 10, 2), "y"), q=("d", lambda: C.decimal(t(), 10, 2), "0"))
fn("cast_date", "ev", r=("D", lambda: C.date(d()), "d"), q=("D", lambda: C.date(e()), "NULL"))
fn("cast_datetime", "ev", r=("t", lambda: C.datetime(d(), 3), "make_timestamp((epoch_us(d) + 500) // 1000 * 1000)"))
fn("cast_time", "ev", r=("s", lambda: T.time_text(C.time(F.date_format(d(), "HH:mm:ss"))), _hms), q=("s", lambda: T.time_text(C.time("-100:00:01")), "'-100:00:01'"))
fn("convert_using", "num", r=("s", lambda: C.convert_using(t(), "UTF-8"), "t"))

# --- aggregates ----------------------------------------------------------------------------------------------------


def agg(name: str, of: str, key: str, sql_key: str, **columns: tuple[str, Callable[[], Column], str]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = base(spark, sf_dir, of)
        rows = rows.groupBy(F.expr(key).alias("g")) if key else rows
        return rows.agg(*[KINDS[kind][0](made()).alias(alias) for alias, (kind, made, _) in columns.items()])

    QUERIES[f"agg_{name}"] = query
    chosen = ", ".join(KINDS[kind][1].format(sql) + " AS " + alias for alias, (kind, _, sql) in columns.items())
    ORACLE_SQL[f"agg_{name}"] = f"SELECT {sql_key + ' AS g, ' if key else ''}{chosen} FROM {base_sql(of)}{' GROUP BY ' + sql_key if key else ''}"


agg("count", "num", "t", "t", a=("l", A.count, "count(*)"), b=("l", lambda: A.count(n()), "count(n)"), h=("l", lambda: A.count(n(), x()), "count(n)"))
agg("count_distinct", "num", "t", "t", a=("l", lambda: A.count_distinct(n()), "count(DISTINCT n)"), b=("l", lambda: A.count_distinct(n(), i() % 3), "count(DISTINCT CASE WHEN n IS NOT NULL THEN n * 10 + i % 3 END)"))
agg("sum", "num", "t", "t", a=("d", lambda: A.sum_(x()), "sum(x)"), b=("l", lambda: A.sum_(n(), distinct=True), "sum(DISTINCT n)"))
agg("avg", "num", "t", "t", a=("d", lambda: A.avg(n()), "avg(n)"), b=("d", lambda: A.avg(n(), distinct=True), "avg(DISTINCT n)"))
agg("min_max", "ev", "e", "e", a=("d", lambda: A.min_(v()), "min(v)"), b=("d", lambda: A.max_(v()), "max(v)"), h=("t", lambda: A.max_(d()), "max(d)"))
agg("std", "num", "t", "t", a=("d", lambda: A.std(n()), "stddev_pop(n)"), b=("d", lambda: A.stddev_samp(n()), "stddev_samp(n)"))
agg("variance", "num", "t", "t", a=("d", lambda: A.variance(n()), "var_pop(n)"), b=("d", lambda: A.var_samp(n()), "var_samp(n)"))
agg("bit", "num", "t", "t", a=("s", lambda: A.bit_and(n()), "bit_and(n::HUGEINT)"), b=("s", lambda: A.bit_or(n()), "bit_or(n::HUGEINT)"), h=("s", lambda: A.bit_xor(n()), "bit_xor(n::HUGEINT)"))
agg("bit_empty", "num", "t", "t", a=("s", lambda: A.bit_and(F.when(n() > 999, n())), "'18446744073709551615'"), b=("s", lambda: A.bit_or(F.when(n() > 999, n())), "'0'"))
agg("group_concat", "num", "t", "t", a=("s", lambda: A.group_concat(n(), order=[(n(), True)]), "left(string_agg(n::VARCHAR, ',' ORDER BY n), 1024)"), b=("s", lambda: A.group_concat(n(), order=[(n(), False)], separator=";"), "left(string_agg(n::VARCHAR, ';' ORDER BY n DESC), 1024)"))
agg("group_concat_distinct", "num", "t", "t", a=("s", lambda: A.group_concat(n(), "x", distinct=True), "left(string_agg(DISTINCT n::VARCHAR || 'x', ',' ORDER BY n::VARCHAR || 'x'), 1024)"))
agg("any_value", "num", "t", "t", a=("b", lambda: A.any_value(n()).isNull() | F.array_contains(F.collect_set("n"), A.any_value(n())), "any_value(n) IS NULL OR any_value(n) IN (SELECT p_size FROM part)"))
agg("global", "num", "", "", a=("l", A.count, "count(*)"), b=("d", lambda: A.sum_(x()), "sum(x)"))
