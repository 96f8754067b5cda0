"""Small tables with nulls, and what the operators give on them."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from quillon.dataset import SQLContext
from quillon.dialect import Engine, rewritten, split_statements
from quillon.functions import scalar as S
from quillon.functions.udf import register, register_aggregate, register_vectorized
from quillon.operators import relational as R
from quillon.operators import stats
from quillon.plans import load
from quillon.sources.tables import Catalog, explain, plan_nodes, profiled, read_delimited, schema_of
from quillon.streaming.windows import distinct_events, file_stream, hop, run_to_table, session, tumble, tumble_counts, with_hop_ids

from .conftest import DATA

ABC = [(0, 1, 2, 3), (1, 2, 3, 4), (2, 3, 4, 5)]


def text(df) -> str:
    return ";".join(",".join("" if v is None else str(v) for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def toy(spark):
    for t, rows in {"a": ABC, "b": ABC, "c": ABC, "d": [(0, 1, 2, 3), (1, 2, None, 4), (2, 2, None, 5), (3, 3, 5, 6)], "r": [(None, 1, 2, 3), (None, 2, None, 4), (3, 3, 4, 5)]}.items():
        spark.createDataFrame(rows, ", ".join(f"{t}{k} int" for k in range(1, 5))).coalesce(1).createOrReplaceTempView(t)
    return Engine(spark)


@pytest.mark.parametrize(
    "sql,want",
    [
        ("select a1 from a where a1 between 1 and 2", "1;2"),
        ("select a2 from a where a1 in (1, 2, 2)", "2;3"),
        ("select d1 from d where d3 not in (2)", "3"),
        ("select d1 from d where d3 not in (2, null)", ""),
        ("select count(), count(d3), sum(d3), min(d3), max(d3) from d", "4,2,7,2,5"),
        ("select count(*), sum(a1), max(a2) from a where a1 > 10", "0,,"),
        ("select a1 from a where exists (select * from b where b2 = a2 and b1 > 0)", "1;2"),
        ("select a1 from a where exists (select 1 from b where b1 = a1 + 1) or a1 == 2", "0;1;2"),
        ("select a1, (select b1 from b where b2 = a2) from a", "0,0;1,1;2,2"),
        ("select a1 from a where a2 > (select avg(b2) from b)", "2"),
        ("select a1 from a where a1 not in (select d3 from d where d3 is not null)", "0;1"),
        ("select a1 from a where a1 not in (select d3 from d)", ""),
        ("select 1 + 2, 'a' || 'b'", "3,ab"),
        ("select d3, count(*) from d group by d3 order by d3", ",2;2,1;5,1"),
        ("select r1 from r order by r1 desc, r2", "3;;"),
        ("select a1 from a order by a1 desc limit 2", "2;1"),
        ("select a1, d1 from a left join d on a1 < d1 and d1 > 2 order by a1", "0,3;1,3;2,3"),
        ("select y.b1 as k, x.a1 from b y join a x on y.b1 = x.a2 order by k", "1,0;2,1"),
        ("with t(x) as (select a1 from a) select t1.x from t t1, t t2 where t1.x = t2.x + 1 order by 1", "1;2"),
        ("select a1 from a union select b1 + 1 from b order by a1", "0;1;2;3"),
        ("select a2 from a union all select a1 from a intersect select 2 order by a2", "2"),
        ("select case a1 when 0 then 'z' when 1 then 'o' else 'm' end from a", "z;o;m"),
        ("select case when a1 > 1 then a1 end from a", ";;2"),
        ("select a1 from a where date '1998-12-01' - interval '90' day > date '1998-09-01'", "0;1;2"),
        ("select date '2001-01-03' + interval '1' month, date '2001-01-03' + 30 days", "2001-02-02,2001-02-02"),
        ("select upper('ab'), repeat('x', 3), coalesce(null, 'q'), abs(-3)", "AB,xxx,q,3"),
        ("select distinct d2 from d order by d2", "1;2;3"),
        ("select count(distinct d2) from d", "3"),
        ("select a1 from a tablesample row (3) order by a1", "0;1;2"),
        ('select "a1" as "Big Name" from a where "a1" = 1', "1"),
    ],
)
def test_statements(toy, sql, want):
    assert text(toy.sql(sql)) == want


def test_compat_mode(spark, toy):
    e = Engine(spark, compat=True)
    assert text(e.sql("select substring('GAMETHEMATICS', 4, 9), substr('abc', 2, 2)")) == "ETHEMA,b"
    assert text(toy.sql("select substring('abcdef', 2, 3)")) == "bcd"
    assert rewritten("select count(), 'count()' -- x == y", True) == "select count(*), 'count()' -- x == y"
    assert split_statements("select ';'; -- a;b\n select 2;") == ["select ';'", "select 2"]


def test_errors(spark, toy):
    with pytest.raises(AnalysisException):
        toy.sql("select nothing from a")
    with pytest.raises(AnalysisException):
        toy.sql("select a1, sum(a2) from a")
    with pytest.raises(AnalysisException):
        toy.sql("select sum(sum(a1)) from a")
    with pytest.raises(PySparkException):
        toy.sql("select a1, (select b1 from b where b1 >= a1) from a").collect()
    with pytest.raises(TypeError, match="character type"):
        S.check_comparable(spark.table("a"), "a1", "'x'")
    S.check_comparable(spark.table("a"), "a1", "a2")
    for n in (0, -1):
        with pytest.raises(ValueError):
            R.limit(spark.table("a"), n)
    with pytest.raises(ValueError, match="matching column count"):
        R.set_ops(spark.table("a"), ("union", spark.table("b").select("b1")))
    with pytest.raises(ValueError):
        R.derived(spark.table("a"), "t", *"vwxyz")


def test_definitions_and_loading(spark, tmp_path):
    e = Engine(spark)
    file = tmp_path / "rows.tbl"
    file.write_text("1|one|2.50|1995-03-01|\n2||7.25|1996-04-02|\n3|three||1997-05-03|\n")
    e.execute("""drop table if exists loaded; create table loaded(k int primary key, name varchar(20) not null, price decimal(7,2), d date, primary key (k)) distributed by k;""")
    e.execute(f"copy loaded from '{file}' where k < 3; insert into loaded values (9, 'nine', 1.0, date '2000-01-01'); insert into loaded(k, name) values (10, 'ten')")
    assert text(e.sql("select k, name, price from loaded order by k")) == "1,one,2.50;2,,7.25;9,nine,1.00;10,ten,"
    e.execute("create unique index by_k on loaded(k); create index by_name on loaded(name)")
    assert [r.k for r in e.catalog.seek("by_k", ">=", 9).orderBy("k").collect()] == [9, 10]
    with pytest.raises(ValueError, match="duplicated"):
        e.execute("insert into loaded values (9, 'again', 1.0, null)")
    e.execute("create unique index other on loaded(k)")
    with pytest.raises(ValueError, match="duplicated"):
        e.execute("insert into loaded values (20, 'x', 1.0, null), (20, 'y', 1.0, null)")
    e.execute("create index by_d on loaded(d)")
    with pytest.raises(ValueError, match="values for"):
        e.execute("insert into loaded values (1, 2)")
    with pytest.raises(ValueError):
        e.catalog.seek("by_k", "<>", 9)
    e.execute("drop index by_name; analyze loaded")
    assert e.statistics["loaded"]["k"].n_rows == 4 and e.statistics["loaded"]["price"].null_frac == pytest.approx(0.25)
    assert "Scan" in e.execute("explain select * from loaded where k = 1")[0]
    assert "Physical" in e.execute("explain verbose select k from loaded")[0]
    full = e.execute("explain full select name, count(*) as n from loaded where k > 5 group by name")[0]
    assert "HashAggregate (rows = 2)" in full and "Row(name='nine', n=1)" in full and "Row(" not in e.execute("explain execute select k from loaded")[0]
    assert {"Aggregate", "Filter"} <= {r.node for r in e.plan("select name, count(*) as n from loaded where k > 5 group by name").collect()}
    plan = explain(spark.table("loaded").groupBy("k").count(), "formatted")
    assert "Exchange" not in plan  # bucketed by its key
    with pytest.raises(ValueError, match="duplicated column"):
        schema_of([("x", "int"), ("X", "int")])
    e.execute("drop table loaded")
    with pytest.raises(AnalysisException):
        spark.table("loaded").collect()
    Catalog(spark).create_table("few", [("x", "integer")], "replicated")
    c = Catalog(spark)
    c.drop_table("few")
    got = read_delimited(spark, str(file), schema_of([("k", "int"), ("name", "text"), ("price", "double precision"), ("d", "date")]))
    assert got.collect()[1] == (2, None, 7.25, dt.date(1996, 4, 2))


def test_operators(spark, toy):
    a, d, r = (spark.table(t) for t in "adr")
    assert text(R.derived(a, "t", "x", "y").filter("t.x > 1")) == "2,3"
    assert sorted(R.mark_join(a.select("a1"), d, F.col("a1").outer() == F.col("d3")).collect()) == [(0, False), (1, False), (2, True)]
    one = R.single_join(a.select("a1"), d.select(F.col("d1").alias("a1"), "d2"), ["a1"], "d2")
    assert sorted(one.collect()) == [(0, 1), (1, 2), (2, 2)]
    with pytest.raises(PySparkException, match="more than one row"):
        R.single_join(a.select(F.col("a1").alias("k")), d.select(F.col("d2").alias("k"), "d1"), ["k"], "d1").collect()
    assert R.null_safe_join(r, r.toDF("s1", "s2", "s3", "s4"), [("r1", "s1")]).count() == 5
    assert r.join(r.toDF("s1", "s2", "s3", "s4"), F.col("r1") == F.col("s1")).count() == 1
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    other = spark.createDataFrame([(0, "x"), (1, "y"), (1, "z")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, R.salted_join(big, other, "k", 5, how).collect())) == sorted(map(str, big.join(other, "k", how).collect()))
    with pytest.raises(ValueError):
        R.salted_join(big, other, "k", 5, "right")
    assert R.sample_rows(big, 10, 1).count() == 10 and 50 < R.sample_percent(big, 10, 1).count() < 150
    assert R.gather(big).rdd.getNumPartitions() == 1 and R.round_robin(big, 6).rdd.getNumPartitions() == 6
    by_key = R.redistribute(big, ["k"], 7).select("k", F.spark_partition_id().alias("p")).distinct()
    assert by_key.count() == 3
    assert R.estimated_bytes(spark.read.parquet(f"{DATA}/nation.parquet")) < 10_000 and "broadcast" not in R.broadcast_if_small(big, 1)._jdf.queryExecution().analyzed().toString().lower()
    nulls = R.set_ops(d.select("d3"), ("except", d.filter("d3 IS NULL").select("d3")))
    assert sorted(r[0] for r in nulls.collect()) == [2, 5]
    rows, seen = profiled(a, "seen")
    rows.collect()
    assert seen.get == {"rows": 3}
    assert {"Aggregate"} <= {r.node for r in plan_nodes(a.groupBy("a1").count()).collect()}


def test_scalars(spark):
    df = spark.createDataFrame([(7, 2, None, "b", dt.date(2001, 1, 3)), (-7, 2, 0.125, "Ab", None)], "x long, y long, z double, s string, d date")
    assert [r[0] for r in df.select(S.int_div("x", "y")).collect()] == [3, -3]
    assert df.agg(S.int_avg("x"), S.int_avg(F.lit(None).cast("int"))).first() == (0, None)
    assert df.select(S.round_half_even("z", 2)).collect()[1][0] == 0.12
    assert [r[0] for r in df.select(S.concat_or_empty("z", "s")).collect()] == ["b", "0.125Ab"]
    assert df.agg(S.sum_strings("s")).first()[0] == "Abb" and df.agg(S.sum_strings("s", -F.col("x"))).first()[0] == "bAb"
    assert [r[0] for r in df.select(S.language_order("s") < S.language_order(F.lit("B"))).collect()] == [True, True]
    assert df.select(S.add_interval("d", 1, "month"), S.add_interval("d", 2, "years")).first() == (dt.date(2001, 2, 2), dt.date(2003, 1, 3))
    assert df.select(S.substr_between("s", 2, 1)).collect()[1][0] == ""
    with pytest.raises(PySparkException):
        df.select(S.int_div("x", F.lit(0))).collect()


def test_dataset_and_functions(spark, toy):
    ctx = SQLContext(spark)
    ctx.register("twice", lambda x: x * 2, int)
    got = ctx.read("a").filter("a1 > 0").join(ctx.read("b"), "b2 = a2").select("a1", "twice(b3) AS t").show()
    assert sorted(got) == [(1, 6), (2, 8)]
    assert ctx.read("d").group("d2").agg("count(*) AS n").order("n desc", "d2").limit(1).show() == [(2, 2)]
    with pytest.raises(PySparkException):
        spark.sql("select twice(1, 2)").collect()
    with pytest.raises(TypeError):
        register(spark, "bad", lambda a, b, c, d: 1, int)
    with pytest.raises(TypeError):
        register(spark, "bad", lambda a: [], list)
    register(spark, "dice", lambda: 0.5, float, deterministic=False)
    assert spark.sql("select dice()").first()[0] == 0.5

    def plus(a: pd.Series, b: pd.Series) -> pd.Series:
        return a + b

    register_vectorized(spark, "plus_all", plus, int)
    register_aggregate(spark, "med", lambda x: float(x.median()), float)
    assert spark.sql("select plus_all(a1, a2) from a order by 1").collect() == [(1,), (3,), (5,)]
    assert spark.sql("select med(a1) from a").first()[0] == 1.0


def test_statistics(spark, tmp_path):
    o = spark.read.parquet(f"{DATA}/orders.parquet")
    s = {c: stats.column_stats(o, c) for c in ("o_orderpriority", "o_totalprice")}
    n = o.count()
    assert s["o_orderpriority"].ndv == 5 and abs(sum(s["o_orderpriority"].common.values()) - 1) < 1e-9
    for cut in (50_000, 200_000, 390_000):
        assert abs(s["o_totalprice"].below(cut) - o.filter(f"o_totalprice <= {cut}").count() / n) < 0.02
    one = o.filter("o_orderpriority LIKE '1%'").count() / n
    assert abs(s["o_orderpriority"].like("1%") - one) < 1e-9 and s["o_orderpriority"].equals("nothing") == 0
    stats.save_stats({"orders": s}, str(tmp_path / "s.json"))
    assert stats.load_stats(str(tmp_path / "s.json")) == {"orders": s}
    assert stats.join_rows(1000, 10, 10, 10) == 1000 and stats.conjunction([0.5, 0.5]) == 0.25
    assert stats.analyze(o.limit(0), ["o_orderkey"]).first() == ("o_orderkey", 0, 0.0, 0)


EVENTS = [("2020-05-12 07:22:16", 0), ("2020-05-12 07:22:17", 1), ("2020-05-12 07:22:26", 2), ("2020-05-12 07:22:28", 3), ("2020-05-12 07:22:56", 4)]


def test_windows(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "t string, k int").select(F.col("t").cast("timestamp_ntz").alias("ts"), "k")
    per = df.groupBy(tumble("ts", 10).alias("w")).agg(F.count("*").alias("n")).orderBy("w")
    assert [r.n for r in per.collect()] == [2, 2, 1]
    hops = with_hop_ids(df, "ts", 5, 10).groupBy("hop").count().orderBy("hop")
    assert [r["count"] for r in hops.collect()] == [2, 4, 2, 1, 1]
    assert [r.n for r in df.groupBy(hop("ts", 10, 5).alias("w")).agg(F.count("*").alias("n")).orderBy("w").collect()] == [2, 2, 2, 2, 1, 1]
    assert [r.n for r in df.groupBy(session("ts", 12).alias("w")).agg(F.count("*").alias("n")).orderBy("w").collect()] == [4, 1]
    src = tmp_path / "in"
    df.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(src))
    like = spark.read.parquet(str(src))
    counts = tumble_counts(file_stream(spark, str(src), "*.parquet", like), "ts", 10, late_seconds=5)
    run_to_table(counts, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()] == [2, 2]  # the last is still open
    late = spark.createDataFrame([("2020-05-12 07:22:16", 9), ("2020-05-12 07:24:00", 10)], "t string, k int").select(F.col("t").cast("timestamp").alias("ts"), "k")
    late.write.mode("append").parquet(str(src))
    run_to_table(tumble_counts(file_stream(spark, str(src), "*.parquet", like), "ts", 10, late_seconds=5), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()] == [2, 2, 1]  # the late row is left out
    once = distinct_events(file_stream(spark, str(src), "*.parquet", like).withColumn("same", F.lit(1)), "same", "ts", 3600)
    run_to_table(once, str(tmp_path / "once"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 1 and distinct_events(df, "k", "ts", 1).count() == 5


def test_plans_push_down(spark):
    q = load()[0]
    plan = explain(q["filter_compare"](spark, DATA), "formatted")
    assert "PushedFilters: [IsNotNull(p_size)" in plan and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
    assert "ExistenceJoin" in explain(q["join_mark"](spark, DATA), "formatted")
    assert "BroadcastHashJoin" in explain(q["join_broadcast"](spark, DATA), "formatted")
    assert "TakeOrderedAndProject" in explain(q["limit_topk"](spark, DATA), "formatted")
