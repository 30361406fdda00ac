import pytest
from pyspark.sql import functions as F

from tesserql.functions import aggregates as A
from tesserql.operators import dml, joins, relational, subqueries
from tesserql.plans import explain
from tesserql.sources import files
from tesserql.streaming import statements


def test_quantified_null_rules(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    some = spark.createDataFrame([(2,), (None,)], "v int")
    none = some.where("v > 99")
    pick = lambda op, q, v: sorted((r.x for r in subqueries.quantified(df, F.col("x"), op, q, v, "v").collect()), key=str)
    assert pick(">", "ANY", some) == [5]
    assert pick(">", "ALL", some) == []
    assert pick(">", "ALL", none) == [1, 5, None]
    assert pick(">", "ANY", none) == []
    assert pick("<>", "ALL", some) == []
    assert pick("=", "ALL", some.where("v = 2")) == []
    assert sorted((r.x for r in subqueries.not_in(df, F.col("x"), none, "v").collect()), key=str) == [1, 5, None]


def test_scalar(spark):
    assert subqueries.scalar(spark.range(0), "id") is None
    with pytest.raises(ValueError):
        subqueries.scalar(spark.range(2), "id")


def test_limits(spark):
    with pytest.raises(ValueError):
        relational.limit(spark.range(3), -1)
    assert relational.limit(spark.range(3), 0).count() == 0
    assert relational.top(spark.range(3), 5, F.col("id"), offset=9).count() == 0
    with pytest.raises(ValueError):
        relational.union(spark.range(1), spark.range(1).withColumn("b", F.lit(1)))


def test_empty_aggregates(spark):
    row = spark.range(0).agg(A.bit_and(F.col("id")), A.bit_or(F.col("id")), A.sum_(F.col("id")), A.count(), A.group_concat(F.col("id"))).first()
    assert [None if v is None else str(v) for v in row] == ["18446744073709551615", "0", None, "0", None]


def test_group_concat(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), (None, 3), ("b", 0)], "s string, n int")
    row = df.agg(A.group_concat(F.col("s"), order=[(F.col("n"), False)], separator="-"), A.group_concat(F.col("s"), distinct=True), A.group_concat(F.col("s"), order=[(F.col("n"), True)], max_len=3)).first()
    assert list(row) == ["b-a-b", "a,b", "b,a"]


def test_dml(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    assert sorted((r.k for r in dml.delete(df, F.col("v") == "a").collect())) == [2, 3]
    assert {r.k: r.v for r in dml.update(df, F.col("v") == "a", v=F.lit("z")).collect()} == {1: "z", 2: None, 3: "c"}
    with pytest.raises(ValueError):
        dml.update(df, F.lit(True), shard_column="k", k=F.lit(1))
    assert {r.k: r.v for r in dml.replace(df, spark.createDataFrame([(3, "n"), (4, "m")], "k int, v string"), ["k"]).collect()} == {1: "a", 2: None, 3: "n", 4: "m"}
    assert {r.k: r.v for r in dml.insert(df.limit(0), spark.createDataFrame([(9,)], "x int"), ["k"]).collect()} == {9: None}


def test_broadcast_is_checked(spark):
    big = spark.range(1000)
    assert "Broadcast" in joins.broadcast_if_small(big)._jdf.queryExecution().optimizedPlan().toString() or joins.plan_bytes(big) <= joins.BROADCAST_BYTES
    assert "isBroadcast" not in str(joins.broadcast_if_small(big, most=1))
    assert joins.plan_bytes(big) == 8000


def test_salted_equals_plain(spark):
    a = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    b = spark.createDataFrame([(0, "x"), (1, "y")], "k long, s string")
    assert sorted(joins.salted(a, b, ["k"], 4).collect()) == sorted(a.join(b, "k").collect())


def test_co_located_tables_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins.write_co_located(spark.range(100).withColumnRenamed("id", "k"), "co_a", "k", 4)
        joins.write_co_located(spark.range(50).withColumnRenamed("id", "k"), "co_b", "k", 4)
        both = spark.table("co_a").join(spark.table("co_b"), "k")
        assert explain.exchanges(both) == 0 and both.count() == 50
        assert explain.explain(both).count() > 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS co_a")
        spark.sql("DROP TABLE IF EXISTS co_b")


def test_load_data(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("1\ta b\n2\t\\N\n")
    assert [tuple(r) for r in files.load_data(spark, str(path), "k int, s string").collect()] == [(1, "a b"), (2, None)]


def test_sequence(spark):
    rows = files.sequence(spark.range(57).select((F.col("id") * 7 % 57).alias("v")), "n", ["v"], start=10).collect()
    assert sorted((r.v, r.n) for r in rows) == [(i, i + 10) for i in range(57)]


def test_sequence_of_a_large_table_with_a_payload(spark):
    rows = files.sequence(spark.range(3_000_000).withColumn("p", F.xxhash64("id")), "n", ["p"])
    got = rows.agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n"), F.sum((F.xxhash64("id") != F.col("p")).cast("int"))).first()
    assert tuple(got) == (3_000_000, 3_000_000, 1, 3_000_000, 0)
    nulls = spark.createDataFrame([(None,), (3,), (None,), (1,)], "v int")
    assert sorted((r.v or 0, r.n) for r in files.sequence(nulls, "n", ["v"]).collect()) == [(0, 1), (0, 2), (1, 3), (3, 4)]
    assert files.sequence(nulls.where("false"), "n", ["v"]).count() == 0


@pytest.mark.parametrize("made", [lambda df: files.batched_sequence(df, "i", 7), lambda df: df.withColumn("i", files.time_sequence(5)), lambda df: df.withColumn("i", files.distributed_sequence(5))])
def test_numbers_of_many_tasks_are_unique(spark, made):
    got = made(spark.range(200_000).repartition(13)).agg(F.count("*"), F.count_distinct("i"), F.min("i")).first()
    assert got[0] == got[1] == 200_000 and got[2] > 0


def test_update_join_updates_a_row_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    source = spark.createDataFrame([(1, "x"), (1, "w"), (None, "y")], "j int, n string")
    from tesserql.operators import dml

    assert sorted(map(tuple, dml.update_join(df, source, {"k": "j"}, v=F.col("n")).collect()), key=repr) == sorted([(1, "w"), (2, "b"), (None, "c")], key=repr)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = statements.windows(stream).writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("seen").collect())) == sorted(map(tuple, statements.windows(events).collect()))


def test_split_dump(spark, tmp_path):
    path = tmp_path / "dump.sql"
    path.write_text("CREATE TABLE a (k int);\nINSERT INTO `a` VALUES (1,'x, (y)',NULL),(2,'it''s; \\'q\\'',-3.5);\nINSERT INTO b (k) VALUES (7);\n")
    got = sorted((r.table_name, list(r.fields)) for r in files.split_dump(spark, str(path)).collect())
    assert got == [("a", ["1", "x, (y)", None]), ("a", ["2", "it's; 'q'", "-3.5"]), ("b", ["7"])]


def test_split_dump_of_hard_literals(spark, tmp_path):
    text = "/* a; */ INSERT INTO `s`.`a` VALUES ('x;\ny',\"d''q\\n\",0x41),\n('--',_binary '\\0','\\\\');\nreplace into b values(1);\n-- it's a note\nINSERT INTO b VALUES (2)"
    (tmp_path / "a.sql").write_text(text)
    want = [("a", ["--", "\0", "\\"]), ("a", ["x;\ny", "d''q\n", "0x41"]), ("b", ["1"]), ("b", ["2"])]
    assert sorted((r.table_name, list(r.fields)) for r in files.split_dump(spark, str(tmp_path / "a.sql"), whole_files=True).collect()) == want
    assert sorted((r.table_name, list(r.fields)) for r in files.split_dump(spark, str(tmp_path / "a.sql")).collect()) == want
    for bad in ("INSERT INTO a VALUES (1,'x' 'y');\n", "INSERT INTO a VALUES (1, (2));\n", "INSERT INTO a VALUES ('x;\n"):
        (tmp_path / "b.sql").write_text(bad)
        with pytest.raises(Exception, match="can't read|is open"):
            files.split_dump(spark, str(tmp_path / "b.sql")).collect()


def test_jdbc_in_ranges(spark, tmp_path):
    """A backend table, read by as many tasks as ranges: the filter goes to the backend."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).selectExpr("cast(id as int) AS K", "concat('v', id) AS V").write.jdbc(url, "T1", properties=driver)
    df = files.jdbc(spark, url, "T1", "K", 0, 100, 4, **driver)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100
    few = df.where("K between 10 and 19")
    assert "PushedFilters: [*IsNotNull(K), *GreaterThanOrEqual(K,10)" in few._jdf.queryExecution().executedPlan().toString() and sorted(r.V for r in few.collect()) == [f"v{i}" for i in range(10, 20)]


def test_split_load(spark, tmp_path):
    from tesserql.plans import sharding as S

    files.split_load(spark.range(20), "id", S.Hash([2], [1]), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["shard_id=0", "shard_id=1"]
    assert spark.read.csv(str(tmp_path / "out")).where("shard_id = 1").count() == 10


def test_global_sequence_bits(spark):
    ids = [r.i for r in spark.range(500).coalesce(1).select(files.time_sequence(5).alias("i")).collect()]
    assert len(set(ids)) == 500 and all(i >> 24 & 1023 == 5 for i in ids)


def test_crc32(spark):
    from tesserql.functions import maths as M

    assert spark.range(1).select(M.crc32("MySQL")).first()[0] == 3259397556


def test_catalog(spark, sf_dir):
    from tesserql.catalog import Catalog, TableConfig
    from tesserql.plans import sharding as S

    c = Catalog(spark, sf_dir, [TableConfig("orders", "sharding", "o_orderkey", S.Hash([4], [1])), TableConfig("lineitem", "child", "l_orderkey", None, "orders", "o_orderkey"), TableConfig("nation", "global", max_rows=3)])
    assert c.co_located("orders", "lineitem") and not c.co_located("orders", "nation")
    assert c.table("nation").count() == 3
    assert {r.name: r.kind for r in c.describe().collect()} == {"orders": "sharding", "lineitem": "child", "nation": "global"}
    assert c.variables().count() > 10
    c.create_table("made", "k int, v string")
    assert c.alter("made", add={"w": "long"}, drop=["v"], rename={"k": "id"}).dtypes == [("id", "int"), ("w", "bigint")]
    c.create_view("some", c.table("region"))
    assert c.truncate("some").count() == 0 and c.drop_view("some")
