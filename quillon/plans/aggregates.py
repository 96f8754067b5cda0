"""Aggregation, set operations and scalar functions through the DataFrame API."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalar import add_interval, concat_or_empty, int_avg, int_div, language_order, round_half_even, substr_between, sum_strings, value_hash
from quillon.operators.relational import set_ops
from quillon.registry import query
from quillon.session import table


@query("agg_global", "SELECT count(*) AS n, count(o_custkey) AS m, min(o_orderkey) AS lo, max(o_orderkey) AS hi, round(sum(o_totalprice), 2) AS s, min(o_orderdate) AS first, max(o_orderpriority) AS p FROM orders")
def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.count("o_custkey").alias("m"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.round(F.sum("o_totalprice"), 2).alias("s"), F.min("o_orderdate").alias("first"), F.max("o_orderpriority").alias("p"))


@query("agg_empty_input", "SELECT count(*) AS n, count(o_custkey) AS m, sum(o_totalprice) AS s, max(o_orderkey) AS hi FROM orders WHERE o_orderkey < 0")
def agg_empty_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderkey < 0")
    return o.agg(F.count("*").alias("n"), F.count("o_custkey").alias("m"), F.sum("o_totalprice").alias("s"), F.max("o_orderkey").alias("hi"))


@query("agg_group", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey")
def agg_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))


@query("agg_group_expr", "SELECT l_quantity > 25 AS big, l_linenumber * 10 AS k, count(*) AS n FROM lineitem GROUP BY l_quantity > 25, l_linenumber * 10")
def agg_group_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_quantity") > 25).alias("big"), (F.col("l_linenumber") * 10).alias("k")).agg(F.count("*").alias("n"))


@query("agg_having", "SELECT l_suppkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey HAVING count(*) > 100 AND min(l_quantity) = 1")
def agg_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.count("*").alias("n"), F.min("l_quantity").alias("lo"))
    return g.filter("n > 100 AND lo = 1").select("l_suppkey", "q")


@query("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, cast(sum(DISTINCT l_linenumber) AS bigint) AS d FROM lineitem GROUP BY l_returnflag")
def agg_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("s"), F.count_distinct("l_partkey").alias("p"), F.sum_distinct("l_linenumber").alias("d"))


@query("agg_avg", "SELECT l_linenumber, round(avg(l_extendedprice), 4) AS a, round(avg(l_linenumber), 4) AS b FROM lineitem GROUP BY l_linenumber")
def agg_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.round(F.avg("l_extendedprice"), 4).alias("a"), F.round(F.avg("l_linenumber"), 4).alias("b"))


@query("agg_avg_int", "SELECT p_type, cast(sum(p_size) // count(p_size) AS bigint) AS a FROM part GROUP BY p_type")
def agg_avg_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(int_avg("p_size").alias("a"))


@query("agg_stddev_samp", "SELECT c_nationkey, round(stddev_samp(c_acctbal), 3) AS s FROM customer GROUP BY c_nationkey")
def agg_stddev_samp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.stddev_samp("c_acctbal"), 3).alias("s"))


@query("agg_of_agg", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t GROUP BY n")
def agg_of_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("customers"))


@query("agg_partial_final", "SELECT l_shipdate, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_shipdate")
def agg_partial_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("agg_sum_strings", "SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_sum_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(sum_strings("n_name").alias("names"))


@query("agg_min_max_string", "SELECT c_mktsegment, min(c_name) AS lo, max(c_name) AS hi FROM customer GROUP BY c_mktsegment")
def agg_min_max_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min("c_name").alias("lo"), F.max("c_name").alias("hi"))


@query("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_ops(_keys(spark, sf_dir, "nation", "n_regionkey"), ("union all", _keys(spark, sf_dir, "region", "r_regionkey")))


@query("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT n_nationkey FROM nation")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_ops(_keys(spark, sf_dir, "nation", "n_regionkey"), ("union", _keys(spark, sf_dir, "nation", "n_nationkey")))


@query("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_ops(_keys(spark, sf_dir, "customer", "c_nationkey"), ("intersect", _keys(spark, sf_dir, "supplier", "s_nationkey")))


@query("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_ops(_keys(spark, sf_dir, "customer", "c_custkey"), ("except", _keys(spark, sf_dir, "orders", "o_custkey")))


@query("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_ops(_keys(spark, sf_dir, "customer", "c_nationkey"), ("intersect all", _keys(spark, sf_dir, "supplier", "s_nationkey")))


@query("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_ops(_keys(spark, sf_dir, "customer", "c_nationkey"), ("except all", _keys(spark, sf_dir, "supplier", "s_nationkey")))


@query("setop_left_to_right", "(SELECT n_regionkey AS k FROM nation UNION SELECT n_nationkey FROM nation) INTERSECT SELECT r_regionkey + 2 FROM region")
def setop_left_to_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 2).alias("k"))
    return set_ops(_keys(spark, sf_dir, "nation", "n_regionkey"), ("union", _keys(spark, sf_dir, "nation", "n_nationkey")), ("intersect", third))


@query("setop_order_limit", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region ORDER BY x DESC LIMIT 7")
def setop_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_ops(_keys(spark, sf_dir, "nation", "n_name", "x"), ("union all", _keys(spark, sf_dir, "region", "r_name"))).orderBy(F.desc("x")).limit(7)


def _keys(spark: SparkSession, sf_dir: str, name: str, column: str, alias: str = "k") -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(column).alias(alias))


@query("fn_substring_end", "SELECT c_custkey, substring(c_name, 3, 5 - 3 + 1) AS s FROM customer")
def fn_substring_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", substr_between("c_name", 3, 5).alias("s"))


@query("fn_round_half_even", "SELECT p_partkey, round_even(p_size / 8.0, 2) AS r FROM part")
def fn_round_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", round_half_even(F.col("p_size").cast("double") / 8.0, 2).alias("r"))


@query("fn_int_div", "SELECT o_orderkey, o_orderkey // 7 AS q, -(o_orderkey // 7) AS m FROM orders")
def fn_int_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", int_div("o_orderkey", F.lit(7)).alias("q"), int_div(-F.col("o_orderkey"), F.lit(7)).alias("m"))


@query("fn_date_interval", "SELECT o_orderkey, cast(o_orderdate AS date) + 90 AS d, cast(o_orderdate AS date) + 30 AS m, cast(o_orderdate AS date) + 365 AS y FROM orders WHERE o_orderdate >= DATE '1998-01-01' - INTERVAL 90 DAY")
def fn_date_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderdate >= DATE '1998-01-01' - INTERVAL '90' DAY")
    d = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", add_interval(d, 90, "day").alias("d"), add_interval(d, 1, "month").alias("m"), add_interval(d, 1, "year").alias("y"))


@query("fn_concat_null_empty", "SELECT p_partkey, coalesce(CASE WHEN p_size > 20 THEN p_name END, '') || p_type AS x FROM part")
def fn_concat_null_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", concat_or_empty(F.when(F.col("p_size") > 20, F.col("p_name")), "p_type").alias("x"))


@query("fn_hash")
def fn_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", value_hash("c_name", "c_nationkey").alias("h"))


@query("fn_collate_order")
def fn_collate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", (language_order("p_name") < language_order(F.lit("Green"))).alias("before"))
