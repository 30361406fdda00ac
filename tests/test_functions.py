"""Edge vectors of the expression helpers: NULL, empty, negative and out-of-range arguments."""

import datetime

import pytest
from pyspark.sql import functions as F

from tesserql.functions import casts as C
from tesserql.functions import compare as P
from tesserql.functions import jsons as J
from tesserql.functions import maths as M
from tesserql.functions import strings as S
from tesserql.functions import temporal as T

NULL = None
DATE = lambda s: F.lit(s).cast("date")
STAMP = lambda s: F.lit(s).cast("timestamp")


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_strings(spark):
    got = values(
        spark, S.insert("Quadratic", 3, 4, "What"), S.insert("Quadratic", -1, 4, "What"), S.insert("Quadratic", 3, 100, "What"), S.lpad("hi", 4, ""), S.lpad("hi", -1, "?"), S.lpad("hi", 1, "??"),
        S.substring("abc", 0), S.substring("Sakila", -3), S.substring("abc", 5), S.soundex("Hello"), S.soundex("Quadratically"), S.elt(4, "a", "b"), S.field(NULL, "a"), S.make_set(5, "hello", "nice", "world"),
        S.make_set(5, "hello", None, "nice", "world"), S.quote("Don't!"), S.quote(NULL), S.trim("xxbarxx", "x"), S.trim("barxxyz", "xyz", "trailing"), S.char(77, 121, 83, 81, 76), S.unhex("GG"), S.concat("My", NULL),
        S.concat_ws(",", "First name", NULL, "Last Name"), S.replace("www", "", "x"), S.space(-1), S.ord_(""), S.find_in_set("b", "a,b,c,d"), S.left("abc", -1),
    )
    assert got == [
        "QuWhattic", "Quadratic", "QuWhat", None, None, "h", "", "ila", "", "H400", "Q36324", None, 0, "hello,world", "hello,nice", "'Don\\'t!'", "NULL", "bar", "barx", "MySQL", None, None,
        "First name,Last Name", "www", "", 0, 2, "",
    ]


def test_maths(spark):
    got = values(spark, M.sqrt(-1), M.acos(2), M.log(1, 8), M.cot(0), M.divide(1, 0), M.mod(7, 0), M.div(7, 0), M.div(-7, 2), M.mod(-7, 2), M.truncate(-1.999, 1), M.truncate(122, -2), M.ln(0), M.conv("a", 16, 2), M.bit_not(F.lit(0)), M.shift_left(1, 64), M.sign(-32))
    assert [None if g is None else str(g) for g in got] == [None, None, None, None, None, None, None, "-3", "-1", "-1.9", "100.0", None, "1010", "18446744073709551615", "0", "-1"]


def test_comparisons(spark):
    got = values(spark, P.greatest(1, NULL), P.least(2, 1), P.in_(F.lit(5), 1, None), P.interval(23, 1, 15, 17, 30, 44, 200), P.interval(NULL, 1), P.is_true(NULL), P.is_not_true(NULL), P.strcmp("a", "b"), P.null_safe_eq(NULL, NULL), P.loose_eq("7abc", 7), P.if_(F.lit(None).cast("boolean"), 1, 2))
    assert got == [None, 1, None, 3, -1, False, True, -1, True, True, 2]


def test_casts(spark):
    got = values(spark, C.signed("12abc"), C.signed("abc"), C.signed("-3.7"), C.unsigned_(F.lit(-1)), C.date("2024-13-01"), C.decimal("12.345x", 6, 2), C.char("hello", 2), T.time_text(C.time("838:59:59")), T.time_text(C.time("-900:00:00")))
    assert [None if g is None else str(g) for g in got] == ["12", "0", "-4", "18446744073709551615", None, "12.35", "he", "838:59:59", "-838:59:59"]
    with pytest.raises(ValueError):
        C.decimal("1", 65, 30)


def mysql_week(d: datetime.date, mode: int) -> int:
    """The documented rules, day by day: week 1 is the first with four days or more, or the first that starts, in the year."""
    monday, whole = bool(mode & 1), bool(mode & 2)
    four = mode in (1, 3, 4, 6)
    first_day = 0 if monday else 6

    def start(year: int) -> datetime.date:
        day = datetime.date(year, 1, 1)
        back = day - datetime.timedelta((day.weekday() - first_day) % 7)
        inside = 7 - (day - back).days
        return back if (inside >= 4 if four else inside == 7) else back + datetime.timedelta(7)

    year = d.year
    if d < start(year):
        if not whole:
            return 0
        year -= 1
    elif whole and d.year < 9999 and d >= start(year + 1):
        year += 1
    return (d - start(year)).days // 7 + 1


@pytest.mark.parametrize("mode", range(8))
def test_week_modes(spark, mode):
    days = [datetime.date(y, m, d) for y in range(2000, 2030) for m, d in ((1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (1, 8), (7, 4), (12, 28), (12, 29), (12, 30), (12, 31))]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", T.week(F.col("d"), mode).alias("w")).collect()
    assert {r["d"]: r["w"] for r in rows} == {d: mysql_week(d, mode) for d in days}


def test_dates(spark):
    got = values(
        spark, T.date_add(DATE("2024-01-31"), 1, "MONTH"), T.to_days(DATE("2007-10-07")), T.from_days(F.lit(730669)), T.period_add(200801, 2), T.period_diff(200802, 200703), T.makedate(2011, 0), T.makedate(2011, 31),
        T.yearweek(DATE("1987-01-01")), T.week(DATE("2008-02-20")), T.week(DATE("2008-12-31"), 1), T.timestampdiff("MONTH", STAMP("2003-02-01"), STAMP("2003-05-01")), T.timestampdiff("YEAR", STAMP("2002-05-01"), STAMP("2001-01-01")),
        T.date_format(STAMP("2009-10-04 22:23:00"), "%W %M %Y"), T.date_format(STAMP("1999-01-01 00:00:00"), "%X %V"), T.date_format(STAMP("2006-06-22 00:00:00"), "%D"), T.extract("DAY_MINUTE", STAMP("2019-07-02 01:02:03")),
        T.time_text(T.sec_to_time(2378)), T.time_text(T.maketime(12, 15, 30)), T.maketime(12, 60, 30).isNull(), T.str_to_date("01,5,2013", "%d,%c,%Y"), T.date_sub(STAMP("2025-01-01 00:00:00"), "1 1:1:1", "DAY_SECOND").cast("string"),
        T.to_seconds(STAMP("2009-11-29 13:43:32")),
    )
    d = datetime.date
    assert got == [
        d(2024, 2, 29), 733321, d(2000, 7, 3), 200803, 11, None, d(2011, 1, 31), 198652, 7, 53, 3, -1, "Sunday October 2009", "1998 52", "22nd", 20102, "00:39:38", "12:15:30", True, d(2013, 5, 1),
        "2024-12-30 22:58:59", 63426721412,
    ]


def test_json(spark):
    doc = '{"id": 1, "a": {"b": [10, 20, {"c": "x"}]}, "s": "q\\"t"}'
    got = values(spark, J.json_extract(doc, "$.id"), J.json_extract(doc, "$.a.b[1]"), J.json_extract(doc, "$.id", "$.a.b[0]"), J.json_extract(doc, "$**.c"), J.json_extract(doc, "$.none"), J.json_value(doc, "$.s"), J.json_extract(doc, "$.id[0]"), J.json_extract("not json", "$.a[0]"))
    assert got == ["1", "20", "[1, 10]", '["x"]', None, 'q"t', "1", None]
