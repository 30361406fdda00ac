"""Statements that need a catalogue: pruning, hints, DML and DDL as text, system tables; and sources that files hold."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, TableConfig
from ..operators import joins
from ..plans import dialect
from ..plans import sharding as S
from ..plans.engine import Engine
from ..sources import files
from ..sources.staging import shared_folder, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = [
    TableConfig("orders", "sharding", "o_orderkey", S.Hash([4], [256])),
    TableConfig("lineitem", "child", "l_orderkey", None, "orders", "o_orderkey"),
    TableConfig("customer", "sharding", "c_custkey", S.NumberRange([(0, 499, 0), (800, 999, 1)], default=2)),
    TableConfig("events", "sharding", "ts", S.DateRange(datetime.date(2024, 1, 1), 10, datetime.date(2024, 12, 31), default=0)),
    TableConfig("nation", "global"),
    TableConfig("region", "global"),
    TableConfig("supplier", "single"),
]


def statements(name: str, sql: str, *texts: str, values: tuple = ()) -> None:
    """Registers the last of some statements, run in order over one catalogue."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(Catalog(spark, sf_dir, TABLES), nodes=4)
        for text in texts[:-1]:
            engine.execute(text)
        return engine.execute(texts[-1], values)

    QUERIES[name], ORACLE_SQL[name] = run, sql


def same(name: str, text: str, hint: str = "") -> None:
    """A statement that DuckDB reads as it is."""
    statements(name, text, hint + text)


same("sql_pruned_units", "SELECT c_custkey, c_name FROM customer WHERE (c_custkey BETWEEN 450 AND 820 OR c_custkey = 77) AND c_nationkey <> 3")
same("sql_pruned_join", "SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderkey IN (7, 300, 1500) AND l.l_orderkey BETWEEN 5 AND 1600")
same("sql_pruned_dates", "SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-02-07 12:00:00'")
same("sql_pruned_subquery", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (3, 600, 850))")
CHAIN = "SELECT c.c_custkey AS k, COUNT(*) AS n FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON n.n_nationkey = c.c_nationkey JOIN orders o ON c.c_custkey = o.o_custkey WHERE r.r_regionkey = 1 AND o.o_totalprice > 200000 GROUP BY c.c_custkey"
same("sql_hint_reduced", CHAIN, "/*#plan=r & n & c & o*/ ")
same("sql_hint_merged", CHAIN, "/*#plan=(r, n) | c | o*/ ")
same("sql_hint_other_order", CHAIN, "/*#plan=o | c | n & r*/ ")
statements("sql_hint_shards", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderkey % 1024) // 256 IN (1, 3) AND o_totalprice > 300000", "/*#shards=1,3*/ SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")


def always_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table of a chain reduced by the keys of one before it."""
    return Engine(Catalog(spark, sf_dir, TABLES), always_reduce=True).execute(CHAIN)


QUERIES["sql_always_reduce"], ORACLE_SQL["sql_always_reduce"] = always_reduce, CHAIN
OUTER = "SELECT n.n_name, COUNT(s.s_suppkey) AS k FROM nation n {} JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 5000 GROUP BY n.n_name"
same("sql_hint_outer", OUTER.format("LEFT"), "/*#plan=n | s*/ ")
statements("sql_hint_left2inner", OUTER.format(""), "/*#plan=s | n $left2inner*/ " + OUTER.format("LEFT"))

statements(
    "sql_dml",
    "SELECT r_regionkey AS k, CASE WHEN r_regionkey < 3 THEN upper(r_name) || '!' ELSE r_name END AS v FROM region WHERE r_regionkey <> 1 UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey + 100 <> 107 UNION ALL SELECT * FROM (VALUES (900, 'it''s'), (901, NULL))",
    "CREATE TABLE kept (k INT, v VARCHAR(40), PRIMARY KEY (k))",
    "INSERT INTO kept SELECT r_regionkey, r_name FROM region",
    "INSERT INTO kept (v, k) SELECT n_name, n_nationkey + 100 FROM nation WHERE n_regionkey = 2",
    "INSERT INTO kept VALUES (900, 'no'), (901, NULL)",
    "UPDATE kept SET v = CONCAT(UPPER(v), '!') WHERE k < 3",
    "DELETE FROM kept WHERE k = 1 OR k = 107",
    "REPLACE INTO kept VALUES (900, 'it''s')",
    "SELECT k, v FROM kept",
)
statements(
    "sql_ddl", "SELECT n_nationkey AS id, CAST(NULL AS BIGINT) AS w FROM nation WHERE n_nationkey > 20",
    "CREATE TABLE made (k INT, v TEXT, d DECIMAL(6,2))", "INSERT INTO made SELECT n_nationkey, n_name, 1.5 FROM nation", "ALTER TABLE made ADD COLUMN w BIGINT, RENAME COLUMN k TO id, DROP COLUMN d", "CREATE INDEX by_id ON made (id)",
    "CREATE OR REPLACE VIEW seen AS SELECT id, w FROM made WHERE id > 20", "TRUNCATE TABLE made", "SELECT * FROM seen",
)
statements("sql_prepared_text", "SELECT n_nationkey, n_name || '-' AS s FROM nation WHERE n_nationkey BETWEEN 3 AND 9", "SET @low = 3, @mark = '-'", "SET @high = @low * 3", "PREPARE p FROM 'SELECT n_nationkey, CONCAT(n_name, ?) AS s FROM nation WHERE n_nationkey BETWEEN ? AND ?'", "EXECUTE p USING @mark, @low, @high")
statements("sql_explain", "SELECT * FROM (VALUES ('shard_0', 'BASE SQL', 'select from orders o'), ('shard_1', 'BASE SQL', 'select from orders o'), ('global', 'BASE SQL', 'select from nation n')) v(sharding_node, type, sql)", "EXPLAIN SELECT * FROM orders o JOIN nation n ON o.o_custkey = n.n_nationkey WHERE o.o_orderkey IN (5, 300)")
_explained = QUERIES["sql_explain"]
QUERIES["sql_explain"] = lambda spark, sf_dir: _explained(spark, sf_dir).where("type = 'BASE SQL'")
statements("sql_show_tables", "SELECT * FROM (VALUES ('nation', 'global'), ('lineitem', 'child'), ('supplier', 'single')) v(table_name, kind)", "SELECT table_name, kind FROM information_schema.tables WHERE table_name IN ('nation', 'lineitem', 'supplier')")
statements("sql_describe", "SELECT * FROM (VALUES ('r_regionkey', 'int', 'YES', 'MUL', NULL, ''), ('r_name', 'string', 'YES', '', NULL, '')) v(\"Field\", \"Type\", \"Null\", \"Key\", \"Default\", \"Extra\")", "CREATE INDEX i ON region (r_regionkey)", "DESC region")
ORACLE_SQL["sql_describe"] = ORACLE_SQL["sql_describe"].replace("SELECT *", 'SELECT "Field", "Type", "Null", "Key", CAST("Default" AS VARCHAR) AS "Default", "Extra"')
statements("sql_information_columns", "SELECT * FROM (VALUES ('n_nationkey', 1), ('n_name', 2), ('n_regionkey', 3)) v(column_name, ordinal_position)", "SELECT column_name, ordinal_position FROM information_schema.columns WHERE table_name = 'nation'")
statements("system_sharding_table", "SELECT * FROM (VALUES ('orders', 'o_orderkey', 'hash'), ('customer', 'c_custkey', 'numberrange'), ('events', 'ts', 'daterange')) v(name, sharding_column, algorithm_name)", "SELECT t.name, s.sharding_column, s.algorithm_name FROM engine_information.table t JOIN engine_information.sharding_table s ON t.id = s.id")
statements("system_child_table", "SELECT * FROM (VALUES ('orders', 'l_orderkey', 'o_orderkey')) v(parent, join_column, parent_column)", "SELECT parent, join_column, parent_column FROM engine_information.child_table")
statements("system_table_node", "SELECT * FROM (VALUES ('orders', CAST(4 AS BIGINT)), ('lineitem', 4), ('customer', 3), ('events', 37), ('nation', 37), ('region', 37), ('supplier', 1)) v(name, nodes)", "SELECT t.name, COUNT(*) AS nodes FROM engine_information.table t JOIN engine_information.table_sharding_node n ON t.id = n.id GROUP BY t.name")
statements("system_algorithm", "SELECT * FROM (VALUES ('hash', 'counts', '[4]'), ('hash', 'lengths', '[256]')) v(name, \"key\", value)", "SELECT name, `key`, value FROM engine_information.algorithm WHERE name = 'hash' AND `key` IN ('counts', 'lengths')")
statements("system_variables", "SELECT 'spark.sql.session.timeZone' AS variable_name, TRUE AS known", "SELECT variable_name, variable_value IS NOT NULL AS known FROM engine_information.variables WHERE variable_name = 'spark.sql.session.timeZone'")


def insert_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VALUES by the sharding column: of a sharded table, its child, and a global one."""
    router = Engine(Catalog(spark, sf_dir, TABLES)).router
    found = [
        router.insert("orders", ["o_orderkey", "o_orderstatus"], [[str(k), "F"] for k in (5, 300, 1023, 1024, -1)]),
        router.insert("lineitem", ["l_orderkey", "l_tax"], [["600", "0.1"]]),
        router.insert("customer", ["c_name", "c_custkey"], [["x", "700"], ["y", "850"]]),
        router.insert("nation", ["n_nationkey", "n_name"], [["99", "z"]], nodes=3),
    ]
    out = found[0].toDF("shard_id", "a", "b")
    for df in found[1:]:
        out = out.union(df)
    return out


QUERIES["sql_insert_routed"] = insert_routed
ORACLE_SQL["sql_insert_routed"] = "SELECT * FROM (VALUES (0, '5', 'F'), (1, '300', 'F'), (3, '1023', 'F'), (0, '1024', 'F'), (3, '-1', 'F'), (2, '600', '0.1'), (2, 'x', '700'), (1, 'y', '850'), (0, '99', 'z'), (1, '99', 'z'), (2, '99', 'z')) v(shard_id, a, b)"


def collation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts group, compare and sort without case."""
    made = Catalog(spark, sf_dir).table("customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.initcap("c_mktsegment")).alias("s"))
    made.select("c_custkey", F.collate("s", "UTF8_LCASE").alias("s")).createOrReplaceTempView("mixed_case")
    return dialect.run(spark, "SELECT UPPER(s) AS seg, COUNT(*) AS n, MIN(c_custkey) AS first FROM mixed_case WHERE s <> 'BUILDING' AND s > 'autoMOBILE' GROUP BY s").select(F.collate("seg", "UTF8_BINARY").alias("seg"), "n", "first")


QUERIES["sql_collation"] = collation
ORACLE_SQL["sql_collation"] = "SELECT c_mktsegment AS seg, count(*) AS n, min(c_custkey) AS first FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_mktsegment > 'AUTOMOBILE' GROUP BY c_mktsegment"


def temp_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An intermediate result, written once and read twice."""
    held = stage(Catalog(spark, sf_dir).table("lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("qty")), "totals")
    most = held.agg(F.max("qty").alias("most"))
    return held.join(F.broadcast(most), F.col("qty") > F.col("most") * 0.9).select("l_suppkey", "qty")


QUERIES["temp_table"] = temp_table
ORACLE_SQL["temp_table"] = "WITH h AS (SELECT l_suppkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1) SELECT l_suppkey, qty FROM h WHERE qty > (SELECT max(qty) FROM h) * 0.9"


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/tesserql/{tag}-{uuid.uuid4().hex}"


def load_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as tab-separated lines with \\N for NULL, loaded again."""
    path = _folder(spark, "load")
    rows = Catalog(spark, sf_dir).table("part").select("p_partkey", "p_name", F.when(F.col("p_size") > 5, F.col("p_size")).alias("p_size"))
    rows.write.option("sep", "\t").option("nullValue", "\\N").csv(path)
    return files.load_data(spark, path, rows.schema)


QUERIES["source_load_data"] = load_data
ORACLE_SQL["source_load_data"] = "SELECT p_partkey, p_name, CASE WHEN p_size > 5 THEN p_size END AS p_size FROM part"


def split_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table split into a set of files a shard; the rows of each."""
    path = _folder(spark, "split")
    files.split_load(Catalog(spark, sf_dir).table("customer").select("c_custkey", "c_name"), "c_custkey", S.Hash([4], [256]), path)
    return spark.read.schema("k long, name string, shard_id int").csv(path).select("shard_id", "k", "name")


QUERIES["source_split_load"] = split_load
ORACLE_SQL["source_split_load"] = "SELECT CAST((c_custkey % 1024) // 256 AS INTEGER) AS shard_id, c_custkey AS k, c_name AS name FROM customer"


def split_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of INSERT statements, read as rows and placed by shard."""
    path, part = _folder(spark, "dump"), Catalog(spark, sf_dir).table("part")
    value = F.concat(F.lit("("), F.col("p_partkey"), F.lit(",'it''s "), F.col("p_name"), F.lit("',NULL)"))
    inserts = part.groupBy((F.col("p_partkey") % 17).alias("g")).agg(F.concat(F.lit("INSERT INTO `part` VALUES "), F.array_join(F.collect_list(value), ",")).alias("value"))
    inserts.select("value").write.option("lineSep", files.END).text(path)
    rows = files.split_dump(spark, path)
    key = F.get("fields", F.lit(0)).cast("long")
    return rows.select("table_name", key.alias("k"), F.get("fields", F.lit(1)).alias("v"), F.get("fields", F.lit(2)).isNull().alias("none"), S.Hash([4], [256]).shard(key).alias("shard_id"))


QUERIES["source_split_dump"] = split_dump
ORACLE_SQL["source_split_dump"] = "SELECT 'part' AS table_name, p_partkey AS k, 'it''s ' || p_name AS v, TRUE AS none, CAST((p_partkey % 1024) // 256 AS INTEGER) AS shard_id FROM part"


def join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent and child in tables bucketed by the order key: their join has no shuffle."""
    catalog, names = Catalog(spark, sf_dir), [f"tesserql_{n}_{uuid.uuid4().hex[:8]}" for n in ("orders", "lineitem")]
    joins.write_co_located(catalog.table("orders").select("o_orderkey", "o_orderstatus"), names[0], "o_orderkey", 8, path=_folder(spark, "bucketed"))
    joins.write_co_located(catalog.table("lineitem").select("l_orderkey", "l_quantity"), names[1], "l_orderkey", 8, path=_folder(spark, "bucketed"))
    both = spark.table(names[0]).join(spark.table(names[1]).hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy("o_orderkey").agg(F.first("o_orderstatus").alias("status"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


QUERIES["join_bucketed"] = join_bucketed
ORACLE_SQL["join_bucketed"] = "SELECT o_orderkey, o_orderstatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL"
