"""Windows over time, for tables and for streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalar import ORIGIN_SECONDS, hop_ids


def _time(ts: str | Column) -> Column:
    return F.col(ts) if isinstance(ts, str) else ts


def tumble(ts: str | Column, seconds: int) -> Column:
    """The tumbling window of a time, counted from 1980-01-01; group by it and read its start and end."""
    return F.window(_time(ts), f"{seconds} seconds", f"{seconds} seconds", f"{ORIGIN_SECONDS % seconds} seconds")


def hop(ts: str | Column, seconds: int, slide_seconds: int) -> Column:
    """All windows of a length that hold a time, one beginning with each slide."""
    return F.window(_time(ts), f"{seconds} seconds", f"{slide_seconds} seconds", f"{ORIGIN_SECONDS % slide_seconds} seconds")


def session(ts: str | Column, gap_seconds: int) -> Column:
    """The window that lasts until no row comes for the gap."""
    return F.session_window(_time(ts), f"{gap_seconds} seconds")


def with_hop_ids(df: DataFrame, ts: str, slide_seconds: int, seconds: int, name: str = "hop") -> DataFrame:
    """Each row once for each window number of hop_ids()."""
    return df.withColumn(name, F.explode(hop_ids(ts, slide_seconds, seconds)))


def file_stream(spark: SparkSession, folder: str, pattern: str, like: DataFrame, files_per_trigger: int = 16) -> DataFrame:
    """Rows of a folder's parquet files that match a pattern, as they come."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumble_counts(events: DataFrame, ts: str, seconds: int, late_seconds: int = 600) -> DataFrame:
    """Counts of each tumbling window; of a stream, rows that are later than the watermark are left out and finished windows leave the state."""
    marked = events.withWatermark(ts, f"{late_seconds} seconds") if events.isStreaming else events
    return marked.groupBy(tumble(ts, seconds).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def distinct_events(events: DataFrame, key: str, ts: str, within_seconds: int) -> DataFrame:
    """The first row of each key; state is kept for as long as duplicates may come."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(ts, f"{within_seconds} seconds").dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, exactly once, into parquet files; a later call goes on from the checkpoint."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
