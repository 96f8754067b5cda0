"""Decision-support query shapes, over the columns that the tables have."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.registry import query
from quillon.session import table


_LINES = "(SELECT *, (1 - l_discount) * l_extendedprice AS net FROM lineitem) li"
_ORDERS = "orders JOIN customer ON c_custkey = o_custkey"
_HOME = "JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"

#: the same results, written for the other engine
SQL = {
    "q01": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(net), 2) AS sum_disc_price,
        round(sum((1 + l_tax) * net), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc,
        count(l_orderkey) AS count_order FROM """
    + _LINES
    + " WHERE NOT l_shipdate > TIMESTAMP '2001-08-01' GROUP BY ALL",
    "q03": f"""SELECT l_orderkey, o_orderdate, round(sum(net), 2) AS revenue FROM {_LINES} JOIN orders ON o_orderkey = l_orderkey
        WHERE l_shipdate > TIMESTAMP '1998-03-15' AND o_orderdate < TIMESTAMP '1998-03-15'
        AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "q04": """WITH late AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45) SELECT o_orderpriority, count(k) AS order_count FROM orders JOIN late ON k = o_orderkey
        WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01' GROUP BY ALL""",
    "q05": f"""SELECT n_name, round(sum(net), 2) AS revenue FROM {_LINES} JOIN {_ORDERS} ON o_orderkey = l_orderkey {_HOME}
        JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey
        WHERE date_part('year', o_orderdate) = 1996 AND r_name = 'ASIA' GROUP BY ALL""",
    "q06": """SELECT round(sum(l_discount * l_extendedprice), 2) AS revenue FROM lineitem
        WHERE date_part('year', l_shipdate) = 1996 AND l_quantity < 24 AND l_discount >= 0.05 AND l_discount <= 0.07""",
    "q07": f"""SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, cast(date_part('year', l_shipdate) AS int) AS l_year, round(sum(net), 2) AS revenue
        FROM {_LINES} JOIN {_ORDERS} ON o_orderkey = l_orderkey JOIN nation b ON b.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation a ON a.n_nationkey = s_nationkey
        WHERE a.n_regionkey = 2 AND b.n_regionkey = 3 AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1997-12-31' GROUP BY ALL""",
    "q08": f"""SELECT cast(date_part('year', o_orderdate) AS int) AS o_year, round(sum(net) FILTER (WHERE o.n_name = 'NATION_7') / sum(net), 6) AS mkt_share
        FROM {_LINES} JOIN {_ORDERS} ON o_orderkey = l_orderkey {_HOME} JOIN supplier ON s_suppkey = l_suppkey JOIN nation o ON o.n_nationkey = s_nationkey
        WHERE r_name = 'AMERICA' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')
        AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1999-12-31' GROUP BY ALL""",
    "q10": f"""SELECT c_custkey, c_name, c_acctbal, n_name, round(sum(net), 2) AS revenue FROM {_LINES} JOIN {_ORDERS} ON o_orderkey = l_orderkey {_HOME}
        WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q13": """WITH per AS (SELECT c_custkey AS k, count(o_orderkey) AS c_count FROM customer LEFT JOIN (SELECT * FROM orders WHERE NOT contains(o_orderpriority, 'URGENT')) o
        ON o_custkey = c_custkey GROUP BY ALL) SELECT c_count, count(k) AS custdist FROM per GROUP BY ALL""",
    "q14": f"""SELECT round(100.0 * sum(net) FILTER (WHERE starts_with(p_type, 'PROMO')) / sum(net), 6) AS promo_revenue FROM {_LINES} JOIN part ON p_partkey = l_partkey
        WHERE l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'""",
    "q15": f"""SELECT s_suppkey, s_name, total_revenue FROM (SELECT *, rank() OVER (ORDER BY total_revenue DESC) AS place FROM (SELECT l_suppkey AS k, round(sum(net), 2) AS total_revenue
        FROM {_LINES} WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' GROUP BY ALL) r) t JOIN supplier ON s_suppkey = k WHERE place = 1""",
    "q17": """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_partkey) AS mean FROM lineitem) l
        JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#23' AND l_quantity < 0.5 * mean""",
    "q18": f"""WITH big AS (SELECT l_orderkey AS k, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL) SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, quantity
        FROM {_ORDERS} JOIN big ON k = o_orderkey WHERE quantity > 200 ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "q19": f"""SELECT round(sum(net), 2) AS revenue FROM {_LINES} JOIN part ON p_partkey = l_partkey
        JOIN (VALUES ('Brand#12', 1, 11, 15), ('Brand#23', 10, 20, 30), ('Brand#14', 20, 30, 45)) v(brand, low, high, size) ON brand = p_brand
        WHERE l_quantity BETWEEN low AND high AND p_size BETWEEN 1 AND size""",
    "q22": """WITH chosen AS (SELECT * FROM customer WHERE c_nationkey IN (1, 3, 7, 10, 13, 17, 23)), mean AS (SELECT avg(c_acctbal) AS m FROM chosen WHERE c_acctbal > 0)
        SELECT c_nationkey, count(c_custkey) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM chosen, mean
        WHERE c_acctbal > m AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000) GROUP BY ALL""",
}


@query("q01", SQL["q01"])
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit(dt.datetime(2001, 8, 1)).cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(disc), 2).alias("sum_disc_price"),
            F.round(F.sum((1 + F.col("l_tax")) * disc), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


def _money() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _ts(year: int, month: int = 1, day: int = 1) -> Column:
    return F.lit(dt.datetime(year, month, day)).cast("timestamp_ntz")


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


@query("q03", SQL["q03"])
def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = _tables(spark, sf_dir, "customer", "orders", "lineitem")
    c = c.filter("c_mktsegment = 'BUILDING'")
    o, li = o.filter(F.col("o_orderdate") < _ts(1998, 3, 15)), li.filter(F.col("l_shipdate") > _ts(1998, 3, 15))
    j = li.join(o.join(c, o.o_custkey == c.c_custkey, "left_semi"), li.l_orderkey == o.o_orderkey)
    g = j.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(_money()), 2).alias("revenue"))
    return g.orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@query("q04", SQL["q04"])
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _tables(spark, sf_dir, "orders", "lineitem")
    o = o.filter((F.col("o_orderdate") >= _ts(1997, 7)) & (F.col("o_orderdate") < _ts(1997, 10)))
    return o.join(li.filter("l_quantity > 45"), o.o_orderkey == li.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("order_count")).orderBy("o_orderpriority")


@query("q05", SQL["q05"])
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li, s, n, r = _tables(spark, sf_dir, "customer", "orders", "lineitem", "supplier", "nation", "region")
    n = n.join(r.filter("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey)
    s = s.join(n, s.s_nationkey == n.n_nationkey)
    o = o.filter((F.col("o_orderdate") >= _ts(1996)) & (F.col("o_orderdate") < _ts(1997))).join(c, F.col("o_custkey") == c.c_custkey)
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return j.groupBy("n_name").agg(F.round(F.sum(_money()), 2).alias("revenue")).orderBy(F.desc("revenue"))


@query("q06", SQL["q06"])
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_shipdate")
    li = table(spark, sf_dir, "lineitem").filter((d >= _ts(1996)) & (d < _ts(1997)) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return li.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("q07", SQL["q07"])
def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, li, o, c, n = _tables(spark, sf_dir, "supplier", "lineitem", "orders", "customer", "nation")
    sn = n.filter("n_regionkey = 2").select(F.col("n_nationkey").alias("sk"), F.col("n_name").alias("supp_nation"))
    cn = n.filter("n_regionkey = 3").select(F.col("n_nationkey").alias("ck"), F.col("n_name").alias("cust_nation"))
    s, c = s.join(sn, s.s_nationkey == sn.sk), c.join(cn, c.c_nationkey == cn.ck)
    li = li.filter(F.col("l_shipdate").between(_ts(1996), _ts(1997, 12, 31)))
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(o, F.col("l_orderkey") == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
    return j.groupBy("supp_nation", "cust_nation", F.year("l_shipdate").alias("l_year")).agg(F.round(F.sum(_money()), 2).alias("revenue"))


@query("q08", SQL["q08"])
def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, li, o, c, n, r = _tables(spark, sf_dir, "part", "supplier", "lineitem", "orders", "customer", "nation", "region")
    home = n.join(r.filter("r_name = 'AMERICA'"), n.n_regionkey == r.r_regionkey, "left_semi").select(F.col("n_nationkey").alias("hk"))
    c = c.join(home, c.c_nationkey == home.hk, "left_semi")
    o = o.filter(F.col("o_orderdate").between(_ts(1996), _ts(1999, 12, 31))).join(c, F.col("o_custkey") == c.c_custkey, "left_semi")
    s = s.join(n.select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nation")), F.col("s_nationkey") == F.col("nk"))
    j = li.join(p.filter("p_type = 'ECONOMY'"), li.l_partkey == p.p_partkey, "left_semi").join(s, F.col("l_suppkey") == s.s_suppkey).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    share = F.sum(F.when(F.col("nation") == "NATION_7", _money()).otherwise(0)) / F.sum(_money())
    return j.groupBy(F.year("o_orderdate").alias("o_year")).agg(F.round(share, 6).alias("mkt_share"))


@query("q10", SQL["q10"])
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li, n = _tables(spark, sf_dir, "customer", "orders", "lineitem", "nation")
    o = o.filter((F.col("o_orderdate") >= _ts(1997, 10)) & (F.col("o_orderdate") < _ts(1998)))
    j = li.filter("l_returnflag = 'R'").join(o, F.col("l_orderkey") == o.o_orderkey)
    g = j.groupBy("o_custkey").agg(F.round(F.sum(_money()), 2).alias("revenue"))  # before the wide join
    full = g.join(c, g.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    return full.select("c_custkey", "c_name", "revenue", "c_acctbal", "n_name").orderBy(F.desc("revenue"), "c_custkey").limit(20)


@query("q13", SQL["q13"])
def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _tables(spark, sf_dir, "customer", "orders")
    per = o.filter(~F.col("o_orderpriority").like("%URGENT%")).groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))  # before the join
    return c.join(per, c.c_custkey == per.o_custkey, "left").groupBy(F.coalesce("n", F.lit(0)).cast("long").alias("c_count")).agg(F.count("*").alias("custdist")).orderBy(F.desc("custdist"), F.desc("c_count"))


@query("q14", SQL["q14"])
def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = _tables(spark, sf_dir, "lineitem", "part")
    li = li.filter((F.col("l_shipdate") >= _ts(1997, 9)) & (F.col("l_shipdate") < _ts(1997, 10)))
    promo = F.when(F.col("p_type").like("PROMO%"), _money()).otherwise(0)
    return li.join(p, li.l_partkey == p.p_partkey).agg(F.round(100.0 * F.sum(promo) / F.sum(_money()), 6).alias("promo_revenue"))


@query("q15", SQL["q15"])
def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s = _tables(spark, sf_dir, "lineitem", "supplier")
    li = li.filter((F.col("l_shipdate") >= _ts(1997)) & (F.col("l_shipdate") < _ts(1997, 4)))
    revenue = li.groupBy("l_suppkey").agg(F.round(F.sum(_money()), 2).alias("total_revenue"))
    best = revenue.join(revenue.agg(F.max("total_revenue").alias("top")), F.col("total_revenue") == F.col("top"))
    return s.join(best, s.s_suppkey == best.l_suppkey).select("s_suppkey", "s_name", "total_revenue")


@query("q17", SQL["q17"])
def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = _tables(spark, sf_dir, "lineitem", "part")
    mine = li.select("l_partkey", "l_quantity", "l_extendedprice").join(p.filter("p_brand = 'Brand#23'"), F.col("l_partkey") == p.p_partkey, "left_semi")
    limits = mine.groupBy("l_partkey").agg((0.5 * F.avg("l_quantity")).alias("most"))
    return mine.join(limits, "l_partkey").filter("l_quantity < most").agg(F.round(F.sum("l_extendedprice") / 7.0, 2).alias("avg_yearly"))


@query("q18", SQL["q18"])
def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = _tables(spark, sf_dir, "customer", "orders", "lineitem")
    big = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity")).filter("quantity > 200")
    j = o.join(big, o.o_orderkey == big.l_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
    return j.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "quantity").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100)


@query("q19", SQL["q19"])
def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = _tables(spark, sf_dir, "lineitem", "part")
    cases = [("Brand#12", 1, 11, 15), ("Brand#23", 10, 20, 30), ("Brand#14", 20, 30, 45)]
    any_of = F.lit(False)
    for brand, low, high, size in cases:
        any_of = any_of | ((F.col("p_brand") == brand) & F.col("l_quantity").between(low, high) & F.col("p_size").between(1, size))
    return li.join(p, (li.l_partkey == p.p_partkey) & any_of).agg(F.round(F.sum(_money()), 2).alias("revenue"))


@query("q22", SQL["q22"])
def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _tables(spark, sf_dir, "customer", "orders")
    c = c.filter(F.col("c_nationkey").isin(1, 3, 7, 10, 13, 17, 23))
    mean = c.filter("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean"))
    rich = c.crossJoin(F.broadcast(mean)).filter("c_acctbal > mean")  # one row
    none = rich.join(o.filter("o_totalprice > 150000"), F.col("c_custkey") == o.o_custkey, "left_anti")
    return none.groupBy("c_nationkey").agg(F.count("*").alias("numcust"), F.round(F.sum("c_acctbal"), 2).alias("totacctbal"))
