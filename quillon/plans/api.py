"""The fluent interface, user functions, sources and sinks, statistics."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.dataset import DataSet
from quillon.dialect import Engine
from quillon.functions.udf import register, register_aggregate
from quillon.operators.relational import sample_percent, sample_rows
from quillon.operators.stats import analyze, common_values, histogram
from quillon.registry import query
from quillon.session import register as views
from quillon.session import table
from quillon.sources.tables import plan_nodes, read_delimited, seek, write_delimited


@query("dataset_filter_join_select", "SELECT c_custkey, o_orderkey, c_nationkey + 1 AS k FROM customer c JOIN orders o ON c_custkey = o_custkey WHERE o_totalprice > 250000")
def dataset_filter_join_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = DataSet(table(spark, sf_dir, "customer").alias("c")), DataSet(table(spark, sf_dir, "orders").alias("o"))
    return c.join(o.filter("o_totalprice > 250000"), "c_custkey = o_custkey").select("c_custkey", "o_orderkey", "c_nationkey + 1 AS k").df


@query("dataset_group_order", "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS m FROM orders GROUP BY o_orderstatus")
def dataset_group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataSet(table(spark, sf_dir, "orders")).group("o_orderstatus").agg("count(*) AS n", "max(o_orderkey) AS m").order("n desc").df


@query("udf_scalar", "SELECT n_nationkey, n_nationkey * n_nationkey + 1 AS v FROM nation")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, "squared_plus_one", lambda x: None if x is None else x * x + 1, int)
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey", "cast(squared_plus_one(n_nationkey) AS int) AS v")


@query("udf_two_args", "SELECT s_suppkey, s_name || ':' || cast(s_nationkey AS varchar) AS v FROM supplier")
def udf_two_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, "labelled", lambda a, b: f"{a}:{b}", str)
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "labelled(s_name, s_nationkey) AS v")


@query("udf_three_args", "SELECT p_partkey, cast(p_size * 2 + p_partkey * 3 - 1 AS double) AS v FROM part")
def udf_three_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, "mixed_up", lambda a, b, c: a * 2.0 + b * 3.0 - c, float)
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "mixed_up(p_size, p_partkey, 1) AS v")


@query("udaf_range", "SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 2) AS spread FROM customer GROUP BY c_nationkey")
def udaf_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_aggregate(spark, "spread_of", lambda x: float(x.max() - x.min()), float)
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.expr("spread_of(c_acctbal)"), 2).alias("spread"))


@query("sample_rows", "SELECT 500 AS n, 500 AS d")
def sample_rows_(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sample_rows(table(spark, sf_dir, "orders").select("o_orderkey"), 500, seed=3)
    return got.agg(F.count("*").cast("int").alias("n"), F.count_distinct("o_orderkey").cast("int").alias("d"))


@query("sample_percent")
def sample_percent_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_percent(table(spark, sf_dir, "orders").select("o_orderkey"), 10, seed=3)


@query(
    "analyze_ndv",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, 1 - count({c}) / count(*) AS null_frac, count(DISTINCT {c}) AS ndv FROM (SELECT p_brand, p_type, nullif(p_size, 7) AS s FROM part)" for c in ("p_brand", "p_type", "s")),
)
def analyze_ndv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(table(spark, sf_dir, "part").select("p_brand", "p_type", F.nullif("p_size", F.lit(7)).alias("s")))


@query(
    "analyze_mcv",
    """SELECT * FROM (SELECT 'c_mktsegment' AS "column", c_mktsegment AS value, count(*) / (SELECT count(*) FROM customer) AS freq, cast(row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS int) AS rank FROM customer GROUP BY c_mktsegment
       UNION ALL SELECT 'c_nationkey', cast(c_nationkey AS varchar), count(*) / (SELECT count(*) FROM customer), cast(row_number() OVER (ORDER BY count(*) DESC, cast(c_nationkey AS varchar)) AS int) FROM customer GROUP BY c_nationkey) t WHERE rank <= 100""",
)
def analyze_mcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common_values(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])


@query("analyze_histogram", "SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def analyze_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = histogram(table(spark, sf_dir, "orders"), "o_totalprice")
    return h.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


@query("index_seek", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def index_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seek(table(spark, sf_dir, "orders"), "o_orderkey", "=", 77).select("o_orderkey", "o_totalprice")


@query("index_range", "SELECT o_orderkey FROM orders WHERE o_orderkey <= 1000")
def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seek(table(spark, sf_dir, "orders"), "o_orderkey", "<=", 1000).select("o_orderkey")


@query("insert_select", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 100, 'added'")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _fresh(spark)
    table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).write.parquet(out)
    spark.createDataFrame([(100, "added")], "k int, name string").write.mode("append").parquet(out)
    return spark.read.parquet(out)


@query("copy_filter", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS s_name, s_acctbal FROM supplier WHERE s_acctbal > 5000")
def copy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _fresh(spark)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).alias("s_name"), "s_acctbal")
    write_delimited(s, out)
    return read_delimited(spark, out, s.schema).filter("s_acctbal > 5000")


@query("explain_plan")
def explain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_nodes(table(spark, sf_dir, "orders").filter("o_orderkey > 5").groupBy("o_custkey").count())


@query("dialect_query", "SELECT substring(c_name, 2, 3) AS s, count(*) AS n FROM customer WHERE c_nationkey = 3 GROUP BY 1")
def dialect_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "customer")
    return Engine(spark, compat=True).sql('select substring("c_name", 2, 4) as s, count() as n from customer where c_nationkey == 3 group by 1')


def _fresh(spark: SparkSession) -> str:
    """A new folder under the one that all executors share; where none is named, as in tests, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='quillon-')}"
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"
