"""Known shards of the partition functions, in Python and as columns."""

import datetime

import pytest
from pyspark.sql import functions as F

from tesserql.plans import sharding as S

DAY = datetime.date
CASES = [
    (S.Hash([2], [512]), {0: 0, 511: 0, 512: 1, 1023: 1, 1024: 0, None: 0}),
    (S.Hash([2], [1]), {0: 0, 1: 1, 2: 0, -1: 1, -2: 0}),
    (S.Hash([3], [1]), {0: 0, 1: 1, 2: 2, 3: 0, -1: 2, -2: 1, -3: 0}),
    (S.Hash([1, 2], [1, 2]), {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 0}),
    (S.StringHash([2], [512], -4, 0), {"aaaabbb0000": 0, "aaaabbb2359": 0}),
    (S.NumberRange(S.ranges(["0-200M=0", "200M1-400M=1", "400M1-600M=2"])), {0: 0, 2000000: 0, 2000001: 1, 4000000: 1, 4000001: 2, 6000000: 2, 6000001: None}),
    (S.Enumeration({"A": 0, "B": 1}), {"A": 0, "B": 1, "C": None}),
    (S.DateRange(DAY(2014, 1, 1), 10), {DAY(2014, 1, 1): 0, DAY(2014, 1, 10): 0, DAY(2014, 1, 11): 1, DAY(2014, 5, 1): 12}),
    (S.DateRange(DAY(2014, 1, 1), 10, DAY(2014, 1, 31)), {DAY(2014, 1, 31): 3, DAY(2014, 2, 1): 3, DAY(2014, 2, 19): 0, DAY(2014, 2, 20): 1, DAY(2014, 3, 2): 2, DAY(2014, 3, 20): 3, DAY(2014, 3, 24): 0}),
    (S.Pattern(256, S.ranges(["1-32=0", "33-64=1", "65-96=2", "97-128=3", "129-160=4", "161-192=5", "193-224=6", "225-256=7", "0-0=7"]), 2), {"0": 7, "45a": 2}),
    (S.JumpHash(5), {"8": 1, "5": 4}),
    (S.JumpHash(4), {"8": 1, "5": 0}),
]


@pytest.mark.parametrize("function, known", CASES)
def test_known_shards(spark, function, known):
    keys = list(known)
    kind = {int: "long", str: "string", DAY: "date"}[type(next(k for k in keys if k is not None))]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], f"i int, k {kind}").select("i", function.shard(F.col("k")).alias("s")).collect()
    assert {keys[r["i"]]: r["s"] for r in rows} == known
    assert {k: function.of(k) for k in keys} == known


def test_too_many_slots():
    with pytest.raises(ValueError):
        S.Hash([3], [1440])


def test_pruning_never_loses_rows(spark):
    df = spark.range(3000).withColumn("k", F.col("id") - 500)
    for function in (S.Hash([2, 1], [256, 512]), S.NumberRange(S.ranges(["0-499=0", "500-999=1"]), 2)):
        t = S.ShardedTable(df, "k", function)
        for low, high in ((-20, 30), (490, 510), (0, 2400), (950, 1200)):
            assert t.where_between(low, high).count() == high - low + 1
        assert t.where_in([1, 2000, 600]).count() == 3
        assert t.where_equal(77).count() == 1


SLICES = [(0, 0), (1, 3), (-3, 0), (2, -1), (-4, -2), (0, 2), (5, 2), (9, 20)]


@pytest.mark.parametrize("start, end", SLICES)
def test_slices_count_16_bit_units(spark, start, end):
    texts = ["abcdefg", "a\U0001f600bc\U00020000", "", "x", "\U0001f600\U0001f600"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.text_hash(F.col("t"), start, end).alias("h")).collect()
    assert {r["t"]: r["h"] for r in rows} == {t: S.sliced_hash(t, start, end) for t in texts}
    assert S.units("a\U0001f600") == [97, 0xD83D, 0xDE00]


def test_pattern_ranges():
    p = S.Pattern(256, S.ranges(["1-32=0", "33-64=1", "65-96=2", "97-128=3", "129-160=4", "161-192=5", "193-224=6", "225-256=7", "0-0=7"]), 2)
    assert p.between("0", "45") == {7, 0, 1} and p.between("1", "45") == {0, 1} and p.between("200", "260") == {6, 7, 0}
    assert p.between("200", "456") is None and p.between("45a", "0") is None and p.between("45", "0") == set()


def test_ranges_with_gaps(spark):
    f = S.NumberRange([(0, 10, 0), (20, 30, 1)], default=2)
    assert f.between(5, 25) == {0, 1, 2} and f.between(2, 9) == {0} and f.between(11, 19) == {2} and f.between(25, 40) == {1, 2} and f.between(9, 3) == set()
    assert S.NumberRange([(0, 10, 0), (11, 30, 1)]).between(5, 25) == {0, 1} and S.NumberRange([(0, 10, 0)]).between(5, 25) is None
    t = S.ShardedTable(spark.createDataFrame([(5,), (15,), (25,)], "k long"), "k", f)
    assert sorted(r["k"] for r in t.where_between(5, 25).collect()) == [5, 15, 25]


def test_date_ranges_are_computed():
    f = S.DateRange(DAY(2014, 1, 1), 10, default=9)
    assert f.between(DAY(2014, 1, 5), DAY(2014, 1, 25)) == {0, 1, 2} and f.between(DAY(2013, 1, 1), DAY(2014, 1, 1)) == {9, 0} and f.between(DAY(2012, 1, 1), DAY(2013, 1, 1)) == {9}
    assert len(f.between(DAY(1, 1, 1), DAY(9999, 12, 31))) > 200_000
    w = S.DateRange(DAY(2014, 1, 1), 10, DAY(2014, 1, 31))
    assert w.between(DAY(2014, 1, 25), DAY(2014, 2, 12)) == {w.of(DAY(2014, 1, 25) + datetime.timedelta(d)) for d in range(19)} and w.between(DAY(2014, 1, 1), DAY(9999, 1, 1)) == {0, 1, 2, 3}
    assert S.DateRange(DAY(2014, 1, 1), 10).between(DAY(2013, 1, 1), DAY(2014, 1, 1)) is None


def test_condition_units():
    assert S.conjunction({1, 2}, None, {2, 3}) == {2}
    assert S.disjunction({1}, {2}) == {1, 2}
    assert S.disjunction({1}, None) is None


def test_text_hash_wraps(spark):
    texts = ["", "a", "\U0001f600x", "\U00020000" * 9, "Customer#000000001", "z" * 40, "\u00e9t\u00e9 \u6f22\u5b57", "0123456789" * 9]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.text_hash(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in rows} == {t: S.sliced_hash(t, 0, 0) for t in texts}
