"""Filters, joins, sub-queries, grouping, sorting, set operations, DML and sources, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, TableConfig
from ..functions import aggregates as A
from ..functions import compare as P
from ..operators import dml, joins, relational, subqueries
from ..sources import files
from ..streaming import statements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
col = F.col


def query(sql: str | None = None):
    """Registers a function of a table reader under its name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir).table)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def revenue():
    return col("l_extendedprice") * (1 - col("l_discount"))


# --- scans, projection, filters ------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 40")
def scan_filter_project(t):
    return t("lineitem").where((col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & (col("l_quantity") > 40)).select("l_orderkey", "l_linenumber", F.round(revenue(), 4).alias("net"))


@query("SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS prio FROM orders WHERE NOT (nullif(o_orderpriority, '5-LOW') = '1-URGENT')")
def filter_3vl(t):
    prio = P.nullif(col("o_orderpriority"), "5-LOW")
    return t("orders").where(P.not_(P.eq(prio, "1-URGENT"))).select("o_orderkey", prio.alias("prio"))


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#1', 'Brand#2')")
def filter_in_lists(t):
    return t("part").where(P.in_(col("p_size"), 1, 5, 9) & ~P.in_(col("p_brand"), "Brand#1", "Brand#2")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size NOT IN (1, NULL)")
def filter_not_in_null(t):
    return t("part").where(~P.in_(col("p_size"), 1, None)).select("p_partkey")


@query("SELECT 1 AS one, 'x' AS s, CAST(NULL AS BIGINT) AS n")
def constant_row(t):
    return relational.constants(t("region"), one=F.lit(1), s=F.lit("x"), n=F.lit(None).cast("long"))


@query("SELECT 'root' AS \"user\", 'root' AS \"current_user\", 'shop' AS database, CAST(0 AS BIGINT) AS last_insert_id, CAST(-1 AS BIGINT) AS row_count, n_nationkey FROM nation")
def session_columns(t):
    nation = t("nation")
    return relational.session_row(nation.sparkSession, "root", "shop").drop("version").crossJoin(nation.select("n_nationkey"))


@query("SELECT upper(p_name) AS name_key, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY upper(p_name)")
def group_case_insensitive(t):
    return relational.group(t("part"), [relational.case_insensitive(col("p_name")).alias("name_key")], F.count("*").alias("n"))


# --- joins ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000")
def join_inner(t):
    return joins.inner(t("orders"), t("customer"), col("o_custkey") == col("c_custkey")).where(col("o_totalprice") > 400000).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def join_left_residual(t):
    on = (col("c_custkey") == col("o_custkey")) & (col("o_orderstatus") == "F")
    return joins.outer(t("customer"), t("orders"), on).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT s_suppkey, n_nationkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def join_right(t):
    return joins.outer(t("supplier"), t("nation"), (col("s_nationkey") == col("n_nationkey")) & (col("s_acctbal") > 5000), "right").select("s_suppkey", "n_nationkey", "n_name")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return joins.inner(t("region"), t("nation")).select("r_name", "n_name")


@query("SELECT * FROM (SELECT n_nationkey AS nk, n_name FROM nation) NATURAL JOIN (SELECT s_nationkey AS nk, s_suppkey FROM supplier)")
def join_natural(t):
    return joins.natural(t("nation").select(col("n_nationkey").alias("nk"), "n_name"), t("supplier").select(col("s_nationkey").alias("nk"), "s_suppkey"))


@query("SELECT * FROM (SELECT n_nationkey AS nk, n_name FROM nation) LEFT JOIN (SELECT c_nationkey AS nk, c_custkey FROM customer WHERE c_acctbal < 0) USING (nk)")
def join_using(t):
    return joins.outer(t("nation").select(col("n_nationkey").alias("nk"), "n_name"), t("customer").where("c_acctbal < 0").select(col("c_nationkey").alias("nk"), "c_custkey"), ["nk"])


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def join_theta_residual(t):
    a, b = t("supplier").alias("a"), t("supplier").alias("b")
    return joins.inner(a, b, (col("a.s_nationkey") == col("b.s_nationkey")) & (col("a.s_acctbal") < col("b.s_acctbal"))).select(col("a.s_suppkey").alias("a"), col("b.s_suppkey").alias("b"))


@query("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey > r_regionkey")
def join_theta(t):
    return joins.inner(t("nation"), t("region"), col("n_regionkey") > col("r_regionkey")).select("n_nationkey", "r_regionkey")


@query("""SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name""")
def join_chain_5(t):
    small = joins.global_join(t("nation"), t("region"), col("r_regionkey") == col("n_regionkey")).select("n_nationkey", "r_name")
    buyers = joins.global_join(t("customer"), small, col("c_nationkey") == col("n_nationkey")).select("c_custkey", "r_name")
    lines = t("lineitem").select("l_orderkey", revenue().alias("net")).join(t("orders").select("o_orderkey", "o_custkey"), col("l_orderkey") == col("o_orderkey"))
    return lines.join(buyers, col("o_custkey") == col("c_custkey")).groupBy("r_name").agg(F.round(F.sum("net"), 2).alias("revenue"))


@query("SELECT n_name, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_global_broadcast(t):
    return joins.global_join(t("customer"), t("nation"), col("c_nationkey") == col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus")
def join_co_located(t):
    """Both sides are dealt by the order key once; `join_bucketed` reads tables that need no shuffle at all."""
    return t("lineitem").select("l_orderkey", "l_quantity").join(t("orders").select("o_orderkey", "o_orderstatus"), col("l_orderkey") == col("o_orderkey")).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9000")
def join_reduced(t):
    small = t("customer").where("c_mktsegment = 'MACHINERY' AND c_acctbal > 9000").select("c_custkey")
    return joins.reduced(t("orders").select("o_orderkey", "o_custkey"), small, "o_custkey", "c_custkey").select("o_orderkey", "c_custkey")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') USING (user_id) GROUP BY user_id")
def join_salted(t):
    users = t("events").where("event_type = 'error'").select("user_id").distinct()
    return joins.salted(t("events").select("user_id", "event_id"), users, ["user_id"], 4).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_hinted_order(t):
    order = [(t("supplier"), None), (t("nation"), "merge"), (t("region"), "shuffle_hash")]
    return joins.hinted(order, [col("s_nationkey") == col("n_nationkey"), col("n_regionkey") == col("r_regionkey")]).select("s_suppkey", "r_name")


# --- sub-queries ---------------------------------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def sub_in(t):
    return joins.semi(t("customer"), t("orders").where("o_totalprice > 450000"), col("c_custkey") == col("o_custkey")).select("c_custkey")


@query("SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_returnflag = 'R')")
def sub_exists(t):
    return joins.semi(t("supplier"), t("lineitem").where("l_quantity > 49 AND l_returnflag = 'R'"), col("s_suppkey") == col("l_suppkey")).select("s_suppkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def sub_not_exists(t):
    return joins.anti(t("customer"), t("orders"), col("c_custkey") == col("o_custkey")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def sub_not_in(t):
    return subqueries.not_in(t("customer"), col("c_custkey"), t("orders"), "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)")
def sub_not_in_null(t):
    values = t("orders").select(P.nullif(col("o_custkey"), 1).alias("v"))
    return subqueries.not_in(t("customer"), col("c_custkey"), values, "v").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1.9 * (SELECT avg(o_totalprice) FROM orders)")
def sub_scalar(t):
    orders = t("orders")
    mean = F.broadcast(orders.agg(F.avg("o_totalprice").alias("mean")))  # one row
    return orders.crossJoin(mean).where("o_totalprice > 1.9 * mean").select("o_orderkey")


def _quantified(name: str, sql: str, op: str, quantifier: str, where: str):
    def run(t):
        values = t("customer").where(where).select("c_acctbal")
        return subqueries.quantified(t("supplier"), col("s_acctbal"), op, quantifier, values, "c_acctbal").select("s_suppkey")

    run.__name__ = name
    query(f"SELECT s_suppkey FROM supplier WHERE {sql}")(run)


_some = "(SELECT c_acctbal FROM customer WHERE c_nationkey = 3 AND c_acctbal BETWEEN 2000 AND 7000)"
_where = "c_nationkey = 3 AND c_acctbal BETWEEN 2000 AND 7000"
_quantified("sub_any_gt", f"s_acctbal > ANY {_some}", ">", "ANY", _where)
_quantified("sub_any_lt", f"s_acctbal < ANY {_some}", "<", "ANY", _where)
_quantified("sub_all_ge", f"s_acctbal >= ALL {_some}", ">=", "ALL", _where)
_quantified("sub_all_lt", f"s_acctbal < ALL {_some}", "<", "ALL", _where)
_quantified("sub_any_eq", f"s_acctbal = ANY {_some}", "=", "ANY", _where)
_quantified("sub_all_ne", f"s_acctbal <> ALL {_some}", "<>", "ALL", _where)
_quantified("sub_any_ne", f"s_acctbal <> ANY {_some}", "<>", "ANY", _where)
_quantified("sub_all_empty", "s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_custkey < 0)", ">", "ALL", "c_custkey < 0")
_quantified("sub_any_empty", "s_acctbal > ANY (SELECT c_acctbal FROM customer WHERE c_custkey < 0)", ">", "ANY", "c_custkey < 0")


@query("SELECT brand, n FROM (SELECT p_brand AS brand, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_brand) d WHERE n > 60")
def sub_derived_table(t):
    return t("part").groupBy(col("p_brand").alias("brand")).agg(F.count("*").alias("n")).where("n > 60")


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT 1.5 * count(*) / count(DISTINCT o_custkey) FROM orders)")
def sub_in_having(t):
    orders = t("orders")
    mean = F.broadcast(orders.agg((1.5 * F.count("*") / F.count_distinct("o_custkey")).alias("mean")))  # one row
    return orders.groupBy("o_custkey").agg(F.count("*").alias("n")).crossJoin(mean).where("n > mean").select("o_custkey", "n")


# --- grouping ------------------------------------------------------------------------------------------------------

PRICING = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net,
round(avg(l_quantity), 4) AS avg_qty, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10"""


@query(PRICING)
def pricing_summary(t):
    rows = t("lineitem").where(col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    sums = [F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(revenue()), 2).alias("sum_net"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n")]
    return relational.group(rows, ["l_returnflag", "l_linestatus"], *sums, having=col("n") > 10, ordered=True)


@query("SELECT CAST(count(*) AS BIGINT) AS n, sum(o_totalprice) AS total, max(o_orderkey) AS k FROM orders WHERE o_orderkey < 0")
def agg_global_empty(t):
    return t("orders").where("o_orderkey < 0").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_orderkey").alias("k"))


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY year(o_orderdate)")
def agg_group_expr(t):
    return relational.group(t("orders"), [F.year("o_orderdate").cast("long").alias("y")], F.count("*").alias("n"))


@query("SELECT p_brand, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_brand > 'Brand#2' GROUP BY p_brand")
def having_to_where(t):
    return relational.group(t("part"), ["p_brand"], F.count("*").alias("n"), having=col("p_brand") > "Brand#2")


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_names(t):
    return t("nation").groupBy("n_regionkey").agg(A.group_concat(col("n_name"), order=[(col("n_name"), True)], separator="|").alias("names"))


# --- sorting, limits, set operations -------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(t):
    return relational.top(t("orders").select("o_orderkey", "o_totalprice"), 25, col("o_totalprice").desc(), col("o_orderkey"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30")
def limit_offset(t):
    return relational.top(t("orders").select("o_orderkey"), 20, col("o_orderkey"), offset=30)


@query("SELECT p_partkey, nullif(p_size, 3) AS s FROM part ORDER BY nullif(p_size, 3) NULLS FIRST, p_partkey DESC LIMIT 60")
def order_nulls_low(t):
    return relational.top(t("part").select("p_partkey", P.nullif(col("p_size"), 3).alias("s")), 60, col("s").asc(), col("p_partkey").desc())


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS s FROM customer ORDER BY upper(s), c_custkey LIMIT 400")
def order_ignoring_case(t):
    mixed = F.when(col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(col("c_mktsegment"))
    return relational.top(t("customer").select("c_custkey", mixed.alias("s")), 400, relational.case_insensitive(col("s")), col("c_custkey"))


@query("SELECT min(c_custkey) AS first, count(*) AS n FROM customer GROUP BY c_mktsegment")
def group_ignoring_case(t):
    mixed = F.when(col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(col("c_mktsegment"))
    return t("customer").groupBy(relational.case_insensitive(mixed)).agg(F.min("c_custkey").alias("first"), F.count("*").alias("n")).select("first", "n")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(t):
    return t("part").select("p_brand", "p_type").distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t):
    return relational.union(t("customer").select(col("c_nationkey").alias("k")), t("supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return relational.union(t("customer").select(col("c_nationkey").alias("k")), t("supplier").select("s_nationkey"), distinct=True)


@query("SELECT c_custkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier ORDER BY bal DESC, k LIMIT 15 OFFSET 5")
def union_top(t):
    a, b = t("customer").select(col("c_custkey").alias("k"), col("c_acctbal").alias("bal")), t("supplier").select(col("s_suppkey").alias("k"), col("s_acctbal").alias("bal"))
    return relational.top_of_union([a, b], 15, col("bal").desc(), col("k"), offset=5)


# --- DML as rewrites, sources, sequences, system tables -------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN round(o_totalprice * 2, 2) ELSE round(o_totalprice, 2) END AS o_totalprice FROM orders")
def dml_update(t):
    out = dml.update(t("orders"), col("o_orderstatus") == "P", o_totalprice=col("o_totalprice") * 2)
    return out.select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT c_custkey, CASE WHEN n_name = 'NATION_3' THEN 'moved' ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def dml_update_join(t):
    source = t("nation").where("n_name = 'NATION_3'")
    return dml.update_join(t("customer"), source, {"c_nationkey": "n_nationkey"}, c_mktsegment=F.lit("moved")).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'O') = 'F', FALSE)")
def dml_delete(t):
    return dml.delete(t("orders"), P.nullif(col("o_orderstatus"), "O") == "F").select("o_orderkey")


@query("SELECT * FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
def dml_insert_select(t):
    return dml.insert(t("region"), t("nation").where("n_regionkey = 1").select(col("n_nationkey") + 100, "n_name"))


@query("SELECT r_regionkey, CASE WHEN r_regionkey < 2 THEN 'new' ELSE r_name END AS r_name FROM region")
def dml_replace(t):
    region = t("region")
    return dml.replace(region, region.where("r_regionkey < 2").select("r_regionkey", F.lit("new").alias("r_name")), ["r_regionkey"])


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_brand, p_partkey) AS BIGINT) AS id FROM part")
def sequence_dense(t):
    return files.sequence(t("part").select("p_partkey", "p_brand"), "id", ["p_brand", "p_partkey"]).select("p_partkey", "id")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS id FROM lineitem")
def sequence_payload(t):
    """The whole of a large table, over more ranges than it has files."""
    return files.sequence(t("lineitem"), "id", ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_extendedprice", "id")


def _unique(ids):
    """Rows, different numbers and the sign of the least: ids of several tasks."""
    return ids.agg(F.count("*").alias("n"), F.count_distinct("id").alias("different"), (F.min("id") > 0).alias("positive"))


UNIQUE_SQL = "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT (c_custkey)) AS BIGINT) AS different, TRUE AS positive FROM customer"


@query(UNIQUE_SQL)
def sequence_time(t):
    return _unique(t("customer").select("c_custkey").repartition(7).select(files.time_sequence(3).alias("id")))


@query(UNIQUE_SQL)
def sequence_distributed(t):
    return _unique(t("customer").select("c_custkey").repartition(7).select(files.distributed_sequence(3).alias("id")))


@query(UNIQUE_SQL)
def sequence_batched(t):
    return _unique(files.batched_sequence(t("customer").select("c_custkey").repartition(7), "id", 50))


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, max(value) AS largest FROM events GROUP BY user_id, event_type")
def statement_statistics(t):
    return statements.by_entry(t("events"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def statement_windows(t):
    return statements.windows(t("events"))


def _system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalog(spark, sf_dir).columns("region", "nation")


QUERIES["system_columns"] = _system
ORACLE_SQL["system_columns"] = """SELECT * FROM (VALUES ('region', 0, 'r_regionkey', 'int', TRUE), ('region', 1, 'r_name', 'string', TRUE), ('nation', 0, 'n_nationkey', 'int', TRUE),
('nation', 1, 'n_name', 'string', TRUE), ('nation', 2, 'n_regionkey', 'int', TRUE)) v(table_name, "position", column_name, type, nullable)"""


def _default_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a default maximum of rows."""
    orders = Catalog(spark, sf_dir, [TableConfig("orders", "sharding", max_rows=1000)]).table("orders")
    return orders.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("different"))


QUERIES["default_limit"] = _default_limit
ORACLE_SQL["default_limit"] = "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS different FROM (SELECT o_orderkey FROM orders LIMIT 1000)"
