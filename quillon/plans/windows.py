"""Time windows over the events table, as a table and as a stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalar import tumble_index
from quillon.registry import query
from quillon.session import table
from quillon.streaming.windows import file_stream, hop, run_to_table, session, tumble, tumble_counts, with_hop_ids

HOURLY = """SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1980-01-01') AS window_start, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1980-01-01') + INTERVAL '1 hour' AS window_end,
    count(*) AS n FROM events GROUP BY ALL"""


@query("tumble_count", HOURLY)
def tumble_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumble_counts(table(spark, sf_dir, "events"), "ts", 3600)


@query("tumble_bounds", "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1980-01-01') AS s, event_type, round(sum(value), 2) AS v FROM events GROUP BY ALL")
def tumble_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy(tumble("ts", 86400).alias("w"), "event_type").agg(F.round(F.sum("value"), 2).alias("v"))
    return g.select(F.col("w.start").alias("s"), "event_type", "v")


@query("tumble_1980_origin", "SELECT time_bucket(INTERVAL '7 minutes', ts, TIMESTAMP '1980-01-01') AS s, count(*) AS n FROM events GROUP BY ALL")
def tumble_1980_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(tumble("ts", 420).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("s"), "n")


@query("tumble_index", "SELECT cast(floor((floor(epoch(ts)) - 315532800) / 3600) AS bigint) AS w, count(*) AS n FROM events GROUP BY ALL")
def tumble_index_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(tumble_index("ts", 3600).alias("w")).agg(F.count("*").alias("n"))


@query("hop_ids_compat", "SELECT cast(floor((floor(epoch(ts)) - 315532800) / 3600) AS bigint) + i AS hop, count(*) AS n FROM events, range(4) r(i) GROUP BY ALL")
def hop_ids_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_hop_ids(table(spark, sf_dir, "events").select("ts"), "ts", 900, 3600).groupBy("hop").agg(F.count("*").alias("n"))


@query("hop_sliding", "SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1980-01-01') - INTERVAL '15 minutes' * i AS s, count(*) AS n FROM events, range(4) r(i) GROUP BY ALL")
def hop_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(hop("ts", 3600, 900).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("s"), "n")


@query(
    "session",
    """SELECT user_id, min(ts) AS s, count(*) AS n FROM (
         SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (
           SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events) a) b
       GROUP BY user_id, k""",
)
def session_(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id", session("ts", 6 * 3600).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("s"), "n")


@query("stream_tumble", HOURLY)
def stream_tumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's whole result, written to the shared folder and complete once all files are read."""
    like = table(spark, sf_dir, "events")
    out = _fresh(spark)
    stream = file_stream(spark, sf_dir, "events.parquet", like)
    counts = tumble_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", 3600)
    counts.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/table")).outputMode("complete").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/table").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n")


@query("stream_append", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    like = table(spark, sf_dir, "events")
    out = _fresh(spark)
    run_to_table(file_stream(spark, sf_dir, "events.parquet", like).select("event_id", "event_type"), f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table").groupBy("event_type").agg(F.count("*").alias("n"))


def _fresh(spark: SparkSession) -> str:
    """A new folder under the one that all executors share; where none is named, as in tests, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='quillon-')}"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
