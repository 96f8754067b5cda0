"""Scans, projections, filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.relational import broadcast_if_small, derived, mark_join, null_safe_join, redistribute, salted_join, top_k
from quillon.registry import query
from quillon.session import table


@query("scan_select_star", "SELECT * FROM nation")
def scan_select_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation")


@query("project_arith", "SELECT l_orderkey, l_linenumber, l_linenumber * 2 + 1 AS a, l_linenumber - 10 AS b, -l_linenumber AS c, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def project_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    net = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (n * 2 + 1).alias("a"), (n - 10).alias("b"), (-n).alias("c"), net)


@query("filter_compare", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_size <> 15")
def filter_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf_dir, "part").filter((s >= 10) & (s < 20) & (s != 15)).select("p_partkey", "p_size")


@query("filter_and_or_not", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND NOT (o_orderpriority LIKE '1%')")
def filter_and_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 300000)) & ~F.col("o_orderpriority").like("1%")
    return table(spark, sf_dir, "orders").filter(keep).select("o_orderkey")


@query("between", "SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 1000 AND 1200")
def between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_retailprice").between(1000, 1200)).select("p_partkey")


@query("not_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45")
def not_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(~F.col("p_size").between(5, 45)).select("p_partkey")


@query("like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'r%t' OR p_type LIKE '_RO%'")
def like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_name").like("r%t") | F.col("p_type").like("_RO%")).select("p_partkey", "p_name")


@query("not_like", "SELECT p_partkey FROM part WHERE p_brand NOT LIKE 'Brand#1%'")
def not_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(~F.col("p_brand").like("Brand#1%")).select("p_partkey")


@query("in_list", "SELECT p_partkey FROM part WHERE p_size IN (1, 7, 49) OR p_type IN ('PROMO', 'SMALL')")
def in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_size").isin(1, 7, 49) | F.col("p_type").isin("PROMO", "SMALL")).select("p_partkey")


@query("not_in_list", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3, 4)")
def not_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(~F.col("p_size").isin(1, 2, 3, 4)).select("p_partkey")


@query("is_null_left_join", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def is_null_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left").filter(F.col("o_orderkey").isNull()).select("c_custkey")


@query("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
def case_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(s == "F", 1).when(s == "O", 2).otherwise(0).alias("code"))


@query("case_searched", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' END AS band FROM part")
def case_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(s < 10, "small").when(s < 30, "medium").alias("band"))


@query("from_subquery_alias", "SELECT k, r FROM (SELECT n_nationkey, n_regionkey, n_name FROM nation WHERE n_nationkey > 5) AS t(k, r, n) WHERE r = 2")
def from_subquery_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = table(spark, sf_dir, "nation").filter("n_nationkey > 5").select("n_nationkey", "n_regionkey", "n_name")
    return derived(inner, "t", "k", "r").filter("t.r = 2")


@query("result_no_from", "SELECT 1 + 2 * 3 AS a, 'x' || 'y' AS b, CAST(NULL AS INTEGER) AS c")
def result_no_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select((F.lit(1) + F.lit(2) * 3).alias("a"), F.concat(F.lit("x"), F.lit("y")).alias("b"), F.lit(None).cast("int").alias("c"))


@query("join_hash_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def join_hash_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders").filter("o_totalprice > 200000"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("join_multi_key", "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_custkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey")
def join_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.join(s, (c.c_custkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey)).select("c_custkey", "s_suppkey")


@query(
    "join_multiway",
    """SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region, nation, customer, orders
       WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey GROUP BY r_name, n_name""",
)
def join_multiway(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("join_theta_nl", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_suppkey <= 20")
def join_theta_nl(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (F.col("a.s_acctbal") < F.col("b.s_acctbal")) & (F.col("a.s_suppkey") <= 20)).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").crossJoin(table(spark, sf_dir, "nation")).select("r_name", "n_name")


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, (c.c_custkey == o.o_custkey) & (o.o_totalprice > 350000), "left").select("c_custkey", "o_orderkey")


@query("join_left_theta", "SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_regionkey > r_regionkey AND n_nationkey < 12")
def join_left_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, (n.n_regionkey > r.r_regionkey) & (n.n_nationkey < 12), "left").select("n_nationkey", "r_regionkey")


@query("join_right", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 350000) o RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders").filter("o_totalprice > 350000"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "right").select("o_orderkey", "c_custkey")


@query("join_full", "SELECT s_suppkey, p_partkey FROM supplier FULL JOIN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) p ON s_suppkey = p_partkey")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part").filter("p_partkey % 3 = 0")
    return s.join(p, s.s_suppkey == p.p_partkey, "full").select("s_suppkey", "p_partkey")


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_totalprice > 100000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("join_broadcast", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), broadcast_if_small(table(spark, sf_dir, "nation"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name")


@query("join_or_condition", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey OR n_nationkey = r_regionkey")
def join_or_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, (n.n_regionkey == r.r_regionkey) | (n.n_nationkey == r.r_regionkey)).select("n_nationkey", "r_regionkey")


@query("join_self_alias", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return n.alias("a").join(n.alias("b"), on).select(F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y"))


@query("join_using", "SELECT n_nationkey, n_name, s_suppkey FROM nation JOIN (SELECT s_suppkey, s_nationkey AS n_nationkey FROM supplier) s USING (n_nationkey)")
def join_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return s.join(table(spark, sf_dir, "nation"), "n_nationkey").select("n_nationkey", "n_name", "s_suppkey")


@query("join_mark", "SELECT n_nationkey, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS mark FROM nation")
def join_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").filter("s_acctbal > 9000")
    return mark_join(n.select("n_nationkey"), s, F.col("n_nationkey").outer() == F.col("s_nationkey"))


@query(
    "join_null_safe",
    "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON nullif(a.n_regionkey, 3) IS NOT DISTINCT FROM nullif(b.n_regionkey, 3) AND a.n_nationkey < b.n_nationkey",
)
def join_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a = n.select(F.col("n_nationkey").alias("x"), F.nullif("n_regionkey", F.lit(3)).alias("rx"))
    b = n.select(F.col("n_nationkey").alias("y"), F.nullif("n_regionkey", F.lit(3)).alias("ry"))
    return null_safe_join(a, b, [("rx", "ry")]).filter("x < y").select("x", "y")


@query("join_salted", "SELECT l_returnflag, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_returnflag")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return salted_join(li, o, "k", 4).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("redistribute", "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY o_custkey")
def redistribute_(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = redistribute(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"])
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


@query("order_multi", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey")
def order_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy(F.desc("o_orderstatus"), "o_totalprice", "o_orderkey")


@query("order_nulls", "SELECT p_partkey, nullif(p_size, 7) AS s FROM part ORDER BY s NULLS FIRST, p_partkey LIMIT 50")
def order_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("s")), 50, F.asc("s"), F.asc("p_partkey"))


@query("order_nulls_last", "SELECT p_partkey, nullif(p_size, 7) AS s FROM part ORDER BY s DESC NULLS LAST, p_partkey LIMIT 50")
def order_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("s")), 50, F.desc("s"), F.asc("p_partkey"))


@query("order_expr_not_selected", "SELECT c_custkey FROM customer ORDER BY c_acctbal * -1, c_custkey LIMIT 25")
def order_expr_not_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "customer"), 25, F.col("c_acctbal") * -1, F.col("c_custkey")).select("c_custkey")


@query("limit_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def limit_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
def offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").offset(20).limit(10)
