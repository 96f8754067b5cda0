"""Queries whose SQL is the same in both engines, or nearly; each is planned by Catalyst from the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.registry import query
from quillon.session import register


def sql_query(name: str, text: str, oracle: str | None = None, *tables: str) -> None:
    """Register a query that is SQL text; `oracle` where the other engine needs another one."""

    @query(name, oracle or text)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, *tables)
        return spark.sql(text)


BIG = "orders", "customer", "lineitem", "nation", "region", "part", "supplier"

# subqueries
for _name, _text in {
    "exists_corr": "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT * FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)",
    "not_exists_corr": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey)",
    "exists_uncorr": "SELECT r_name FROM region WHERE EXISTS (SELECT * FROM nation WHERE n_nationkey > 20)",
    "exists_or_mark": "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT * FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9500) OR n_nationkey < 3",
    "exists_nested": """SELECT r_regionkey FROM region WHERE EXISTS (SELECT * FROM nation WHERE n_regionkey = r_regionkey
        AND EXISTS (SELECT * FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000))""",
    "in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 50000)",
    "not_in_subquery_null": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 5) FROM orders)",
    "in_correlated": "SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < n_nationkey AND r_name <> 'ASIA')",
    "scalar_uncorr": "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
    "scalar_corr_agg": """SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity >
        (SELECT 1.9 * avg(l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)""",
    "scalar_in_select": "SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation",
    "scalar_single_join": "SELECT n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS region_name FROM nation",
    "scalar_empty_is_null": "SELECT n_name, (SELECT max(r_name) FROM region WHERE r_regionkey = n_regionkey AND r_regionkey > 2) AS r FROM nation",
    # a reference two levels up, which is made a join on the keys that correlate
    "having_subquery": """SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey
        HAVING count(*) > (SELECT 1.5 * count(*) / count(DISTINCT o_custkey) FROM orders)""",
    "group_by_subquery": """SELECT k, count(*) AS n FROM (SELECT n_nationkey, (SELECT max(s_suppkey) % 3 FROM supplier WHERE s_nationkey = n_nationkey) AS k FROM nation) t
        GROUP BY k""",
    "from_subquery_nested": "SELECT a, count(*) AS n FROM (SELECT b % 5 AS a FROM (SELECT c_custkey AS b FROM customer WHERE c_acctbal > 0) x WHERE b > 10) y GROUP BY a",
    "subquery_in_case": "SELECT n_nationkey, CASE WHEN n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') THEN 'a' ELSE 'b' END AS side FROM nation",
    "subquery_both_sides": "SELECT s_suppkey FROM supplier WHERE s_acctbal BETWEEN (SELECT avg(s_acctbal) FROM supplier) AND (SELECT max(s_acctbal) FROM supplier) - 100",
    "exists_theta": "SELECT s_suppkey FROM supplier a WHERE NOT EXISTS (SELECT * FROM supplier b WHERE b.s_acctbal > a.s_acctbal AND b.s_nationkey = a.s_nationkey)",
}.items():
    sql_query(_name, _text, None, *BIG)

sql_query(
    "corr_two_levels",
    """SELECT DISTINCT r.r_regionkey FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey
       JOIN (SELECT s_nationkey, max(s_suppkey) AS top FROM supplier GROUP BY s_nationkey) s ON s.s_nationkey = n.n_nationkey WHERE s.top > 90 + r.r_regionkey""",
    """SELECT r_regionkey FROM region r WHERE EXISTS (SELECT * FROM nation n WHERE n.n_regionkey = r.r_regionkey
       AND EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_suppkey > 90 + r.r_regionkey))""",
    *BIG,
)

# aggregation
sql_query("agg_group_ordinal", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1", None, "orders")
sql_query("agg_group_alias", "SELECT l_linenumber % 3 AS k, count(*) AS n FROM lineitem GROUP BY k", None, "lineitem")
sql_query("agg_group_null", "SELECT nullif(p_size, 7) AS k, count(*) AS n, count(nullif(p_size, 7)) AS m FROM part GROUP BY nullif(p_size, 7)", None, "part")
sql_query(
    "agg_having_subquery_outer",
    "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) >= (SELECT max(n_regionkey) FROM nation) * 10",
    None,
    "customer",
    "nation",
)
sql_query(
    "agg_rollup",
    "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    None,
    "lineitem",
)
sql_query(
    "agg_grouping_sets",
    """SELECT l_returnflag, l_linestatus, cast(grouping(l_returnflag) AS int) AS g, count(*) AS n FROM lineitem
       GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""",
    None,
    "lineitem",
)
sql_query("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None, "orders")
sql_query(
    "window_rank",
    """SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS r,
       row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier""",
    """SELECT s_suppkey, cast(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS int) AS r,
       cast(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS int) AS n FROM supplier""",
    "supplier",
)
sql_query(
    "window_running",
    """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
       lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders""",
    None,
    "orders",
)

# set operations, distinct, common table expressions
sql_query("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None, "orders")
sql_query("cte_single", "WITH t AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) SELECT k, n FROM t WHERE n > 50", None, "customer")
sql_query("cte_multi_ref", "WITH t AS (SELECT s_nationkey AS k, max(s_acctbal) AS m FROM supplier GROUP BY s_nationkey) SELECT a.k, b.k AS k2 FROM t a JOIN t b ON a.m < b.m", None, "supplier")
sql_query("cte_chained", "WITH a AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), b AS (SELECT r, count(*) AS n FROM a GROUP BY r), unused AS (SELECT * FROM a) SELECT r_name, n FROM b JOIN region ON r = r_regionkey", None, "nation", "region")
sql_query("cte_columns", "WITH t(a, b) AS (SELECT n_nationkey, n_name FROM nation) SELECT a, b FROM t WHERE a > 10", None, "nation")
sql_query("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t", None, "nation")
sql_query("values_query", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(x, y)", None, "nation")
sql_query("not_null_predicate", "SELECT p_partkey FROM part WHERE nullif(p_size, 7) IS NOT NULL AND p_size > 40", None, "part")
sql_query("three_valued_logic", "SELECT p_partkey, (nullif(p_size, 7) > 5 OR p_size = 7) AS a, (nullif(p_size, 7) > 5 AND p_size = 8) AS b, NOT (nullif(p_size, 7) > 5) AS c FROM part", None, "part")

# scalar expressions
sql_query("fn_coalesce", "SELECT p_partkey, coalesce(nullif(p_size, 7), -1) AS s FROM part", None, "part")
sql_query("fn_abs", "SELECT c_custkey, abs(c_acctbal) AS a, abs(c_nationkey - 10) AS b FROM customer", None, "customer")
sql_query("fn_repeat", "SELECT r_name, repeat(r_name, 3) AS r3 FROM region", None, "region")
sql_query("fn_upper_concat", "SELECT upper(c_name) || '-' || lower(c_mktsegment) AS x, c_custkey FROM customer", None, "customer")
sql_query("fn_year", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders", "SELECT o_orderkey, cast(year(o_orderdate) AS int) AS y, cast(month(o_orderdate) AS int) AS m FROM orders", "orders")
sql_query("fn_cast", "SELECT o_orderkey, cast(o_orderkey AS string) AS s, cast(o_orderdate AS date) AS d, cast(substring(o_orderpriority, 1, 1) AS int) AS p FROM orders", "SELECT o_orderkey, cast(o_orderkey AS varchar) AS s, cast(o_orderdate AS date) AS d, cast(substring(o_orderpriority, 1, 1) AS int) AS p FROM orders", "orders")
sql_query("fn_bits", "SELECT o_orderkey, o_orderkey % 7 AS m, o_orderkey & 12 AS a, o_orderkey | 3 AS b FROM orders", None, "orders")
sql_query("fn_rlike", "SELECT p_partkey FROM part WHERE p_brand RLIKE '#[23]4?$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[23]4?$')", "part")

# an aggregate of the outer query inside a subquery
sql_query(
    "agg_outer_in_subquery",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING o_custkey <= (SELECT max(s_suppkey) FROM supplier WHERE s_suppkey > count(orders.o_orderkey) * 5)",
    """WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
       SELECT o_custkey, n FROM g WHERE o_custkey <= (SELECT max(s_suppkey) FROM supplier WHERE s_suppkey > n * 5)""",
    "orders",
    "supplier",
)

# star joins that end in a few minima, as join-order benchmarks have them
sql_query(
    "join_order_chain",
    """SELECT min(n_name) AS nation, min(p_name) AS part, min(c_name) AS customer, count(*) AS n
       FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
       WHERE p_type IN ('PROMO', 'LARGE') AND p_name LIKE '%widget%' AND c_mktsegment <> 'BUILDING' AND o_totalprice > 100000""",
    None,
    *BIG,
)
sql_query(
    "join_order_two_facts",
    """SELECT max(s_name) AS supplier, min(r_name) AS region, count(DISTINCT c_custkey) AS customers
       FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey
       JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE l_returnflag = 'R' AND (r_name LIKE 'A%' OR r_name LIKE '%EAST')""",
    None,
    *BIG,
)
# decision-support shapes: ratios by period, conditional sums, the same fact table joined with itself over years
sql_query(
    "channel_years",
    """WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS yr, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey, year(o_orderdate))
       SELECT a.k, round(b.total / a.total, 4) AS ratio FROM y a JOIN y b ON a.k = b.k AND b.yr = a.yr + 1 WHERE a.yr = 1997 AND a.total > 0""",
    None,
    "orders",
)
sql_query(
    "weekday_pivot",
    """SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 2) AS returned, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END), 2) AS fresh,
       round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2) AS open FROM lineitem GROUP BY l_suppkey""",
    None,
    "lineitem",
)
