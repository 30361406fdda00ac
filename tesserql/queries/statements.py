"""MySQL statements as text, translated and run over views; DuckDB's SQL says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog
from ..plans import dialect

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def statement(name: str, tables: str, mysql: str, sql: str, **parameters) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        Catalog(spark, sf_dir).register(*tables.split())
        return dialect.run(spark, mysql, **parameters)

    QUERIES[name], ORACLE_SQL[name] = run, sql


statement("sql_limit_offset", "orders", "SELECT `o_orderkey` AS k FROM orders ORDER BY o_orderkey LIMIT 10, 5", "SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10")
statement("sql_or_and_not", "part", "SELECT p_partkey FROM part WHERE p_size < 3 || p_brand = \"Brand#4\" && !(p_size > 20) # comment\n", "SELECT p_partkey FROM part WHERE p_size < 3 OR p_brand = 'Brand#4' AND NOT (p_size > 20)")
statement(
    "sql_group_concat", "nation", "SELECT n_regionkey AS r, GROUP_CONCAT(DISTINCT n_name ORDER BY n_name DESC SEPARATOR ';') AS names, COUNT(*) AS n FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey AS r, string_agg(DISTINCT n_name, ';' ORDER BY n_name DESC) AS names, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY n_regionkey",
)
statement(
    "sql_quantified", "supplier customer", "SELECT s_suppkey FROM supplier WHERE s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 3 AND c_acctbal < 5000) AND s_nationkey = ANY (SELECT c_nationkey FROM customer)",
    "SELECT s_suppkey FROM supplier WHERE s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 3 AND c_acctbal < 5000) AND s_nationkey IN (SELECT c_nationkey FROM customer)",
)
statement("sql_json_arrow", "events", "SELECT e.event_id, e.props->>'$.k' AS t, e.props->'$.k' AS j FROM events e WHERE e.event_type <=> 'click'", "SELECT event_id, json_extract_string(props, '$.k') AS t, json_extract_string(props, '$.k') AS j FROM events WHERE event_type = 'click'")
statement(
    "sql_functions", "orders customer", "SELECT o.o_orderkey, DATE_FORMAT(o.o_orderdate, '%Y/%m on %W') AS f, GREATEST(o.o_custkey, NULLIF(c.c_nationkey, 3)) AS g, LPAD(c.c_name, 4, '') AS p, FIELD(o.o_orderstatus, 'F', 'O') AS i, TO_DAYS(o.o_orderdate) AS d FROM orders o STRAIGHT_JOIN customer c ON o.o_custkey = c.c_custkey FOR UPDATE",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m on %A') AS f, CASE WHEN c_nationkey <> 3 THEN greatest(o_custkey, c_nationkey) END AS g, left(c_name, 4) AS p, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS i, date_diff('day', DATE '0001-01-01', o_orderdate) + 366 AS d FROM orders JOIN customer ON o_custkey = c_custkey",
)
statement(
    "sql_derived_union", "customer supplier", "SELECT k, SUM(n) AS n FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT s_nationkey, COUNT(*) FROM supplier GROUP BY s_nationkey) t GROUP BY k HAVING SUM(n) > 5 ORDER BY k",
    "SELECT k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY s_nationkey) t GROUP BY k HAVING sum(n) > 5",
)
statement("sql_prepared", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN :low AND :high AND o_orderstatus = :s", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus = 'F'", low=1000, high=50000, s="F")
statement(
    "sql_strings", "part", "SELECT p_partkey AS k, SUBSTRING_INDEX(p_name, ' ', 1) AS a, INSERT(p_name, 2, 3, 'xy') AS b, FIND_IN_SET(p_brand, 'Brand#1,Brand#3') AS c, TRIM(LEADING 'B' FROM p_brand) AS d, FORMAT(p_retailprice, 1) AS e, HEX(p_brand) AS f, LOCATE('#', p_brand) AS g, MAKE_SET(p_size & 3, 'x', 'y') AS h FROM part",
    "SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS a, left(p_name, 1) || 'xy' || substr(p_name, 5) AS b, CASE p_brand WHEN 'Brand#1' THEN 1 WHEN 'Brand#3' THEN 2 ELSE 0 END AS c, ltrim(p_brand, 'B') AS d, format('{:,.1f}', p_retailprice) AS e, hex(p_brand) AS f, 6 AS g, CASE p_size & 3 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN 'y' ELSE 'x,y' END AS h FROM part",
)
statement(
    "sql_numbers", "part", "SELECT p_partkey AS k, TRUNCATE(p_retailprice, 1) AS a, ROUND(p_retailprice, -2) AS b, CONV(p_size, 10, 2) AS c, p_size XOR p_size - 1 AS d, '3 apples' + p_size AS e, BIT_COUNT(p_size) AS f, p_size / (p_size - 10) AS g, MOD(p_size, 7) AS h, POW(p_size, 2) AS i FROM part",
    "SELECT p_partkey AS k, trunc(p_retailprice * 10) / 10 AS a, round(p_retailprice, -2) AS b, bin(p_size) AS c, (p_size <> 0) <> (p_size - 1 <> 0) AS d, 3 + p_size AS e, CAST(bit_count(p_size) AS INTEGER) AS f, CASE WHEN p_size <> 10 THEN p_size / (p_size - 10) END AS g, p_size % 7 AS h, pow(p_size, 2) AS i FROM part",
)
statement(
    "sql_dates", "orders", "SELECT o_orderkey AS k, WEEK(o_orderdate, 3) AS a, PERIOD_ADD(EXTRACT(YEAR_MONTH FROM o_orderdate), 2) AS b, TIMESTAMPDIFF(MONTH, '1992-01-01', o_orderdate) AS c, CAST(STR_TO_DATE(DATE_FORMAT(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') AS CHAR) AS d, TIME_TO_SEC(o_orderdate) + TIME_TO_SEC('01:05:06') AS e, CAST(LAST_DAY(o_orderdate) AS CHAR) AS f, DAYOFYEAR(o_orderdate) AS g FROM orders",
    "SELECT o_orderkey AS k, CAST(week(o_orderdate) AS INTEGER) AS a, CAST(strftime(o_orderdate + INTERVAL 2 MONTH, '%Y%m') AS BIGINT) AS b, date_diff('month', DATE '1992-01-01', date_trunc('month', o_orderdate)) AS c, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate) + 3906 AS e, CAST(last_day(o_orderdate) AS VARCHAR) AS f, CAST(dayofyear(o_orderdate) AS INTEGER) AS g FROM orders",
)
statement(
    "sql_intervals", "orders", "SELECT o_orderkey AS k, CAST(DATE(DATE_ADD(o_orderdate, INTERVAL 1 MONTH)) AS CHAR) AS a, CAST(DATE(o_orderdate - INTERVAL 3 DAY) AS CHAR) AS b, CAST(DATE(SUBDATE(o_orderdate, 31)) AS CHAR) AS c FROM orders WHERE o_orderdate >= '1995-01-31' + INTERVAL 1 MONTH AND o_orderdate < DATE_SUB('1996-03-31', INTERVAL 1 MONTH)",
    "SELECT o_orderkey AS k, CAST(CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS a, CAST(CAST(o_orderdate - INTERVAL 3 DAY AS DATE) AS VARCHAR) AS b, CAST(CAST(o_orderdate - INTERVAL 31 DAY AS DATE) AS VARCHAR) AS c FROM orders WHERE o_orderdate >= DATE '1995-02-28' AND o_orderdate < DATE '1996-02-29'",
)
statement(
    "sql_control", "part", "SELECT p_partkey AS k, IF(p_size > 10, 'big', 'small') AS a, IFNULL(NULLIF(p_size, 3), -1) AS b, INTERVAL(p_size, 10, 20, 30) AS c, STRCMP(p_brand, 'Brand#3') AS d, COALESCE(NULL, p_size) AS e, ISNULL(NULLIF(p_size, 3)) AS f, IF(p_size - 3, 1, 0) AS g FROM part WHERE p_size <=> 3 OR p_size > '7'",
    "SELECT p_partkey AS k, CASE WHEN p_size > 10 THEN 'big' ELSE 'small' END AS a, coalesce(nullif(p_size, 3), -1) AS b, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END AS c, CASE WHEN p_brand < 'Brand#3' THEN -1 WHEN p_brand > 'Brand#3' THEN 1 ELSE 0 END AS d, p_size AS e, p_size = 3 AS f, CASE WHEN p_size <> 3 THEN 1 ELSE 0 END AS g FROM part WHERE p_size = 3 OR p_size > 7",
)
statement(
    "sql_casts", "events", "SELECT event_id AS k, CAST(CONCAT(user_id, 'x') AS SIGNED) AS a, CAST('12.345 m' AS DECIMAL(6,2)) AS b, CAST('10:11:12' AS TIME) = MAKETIME(10, 11, 12) AS c, CONVERT(event_type, CHAR(2)) AS d, CONVERT(CONCAT(event_type, '漢') USING latin1) AS e, CAST(value AS CHAR) IS NULL AS f FROM events",
    "SELECT event_id AS k, user_id AS a, CAST(12.35 AS DECIMAL(6,2)) AS b, TRUE AS c, left(event_type, 2) AS d, event_type || '?' AS e, FALSE AS f FROM events",
)
statement(
    "sql_all_any", "part supplier", "SELECT s_suppkey AS k FROM supplier WHERE s_nationkey <> ANY (SELECT p_size FROM part WHERE p_size < 3) AND NOT (s_nationkey = ALL (SELECT p_size FROM part WHERE p_size = 7)) AND s_nationkey = ALL (SELECT p_size FROM part WHERE p_size > 900)",
    "SELECT s_suppkey AS k FROM supplier WHERE EXISTS (SELECT 1 FROM part WHERE p_size < 3 AND p_size <> s_nationkey) AND s_nationkey <> 7",
)
statement("sql_json_paths", "events", "SELECT event_id AS k, JSON_EXTRACT(CONCAT('[', props, ', {\"k\": 0}]'), '$[*].k') AS a FROM events", "SELECT event_id AS k, '[' || json_extract_string(props, '$.k') || ', 0]' AS a FROM events")
statement("sql_positional", "orders", "SELECT o_orderkey, CONCAT(?, o_orderstatus) AS s FROM orders WHERE o_totalprice BETWEEN ? AND ? AND o_orderstatus = ?", "SELECT o_orderkey, '?' || o_orderstatus AS s FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus = 'F'", values=["?", 1000, 50000, "F"])
statement("sql_correlated", "customer orders", "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
statement("sql_order_by_subquery", "nation", "SELECT n_name FROM nation ORDER BY n_regionkey = (SELECT MAX(n_regionkey) FROM nation) DESC, n_name LIMIT 7", "SELECT n_name FROM nation ORDER BY n_regionkey = (SELECT max(n_regionkey) FROM nation) DESC, n_name LIMIT 7")
