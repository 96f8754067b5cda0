"""Table statistics and the selectivities that they imply."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMMON = 100
BUCKETS = 100


def analyze(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, n_rows, null_frac, ndv) of each column, in one pass over the table; ndv is estimated unless exact."""
    columns = columns or df.columns
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = [a for i, c in enumerate(columns) for a in (F.count(f"`{c}`").alias(f"n{i}"), distinct(F.col(f"`{c}`")).alias(f"d{i}"))]
    one = df.agg(F.count("*").alias("n"), *aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.when(F.col("n") > 0, 1 - F.col(f"n{i}") / F.col("n")).otherwise(F.lit(0.0)).alias("null_frac"), F.col(f"d{i}").alias("ndv")) for i, c in enumerate(columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def common_values(df: DataFrame, columns: list[str], most: int = COMMON) -> DataFrame:
    """(column, value, freq, rank): the most frequent values of each column with their share of all rows; one shuffle for all columns."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    counts = df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("column", "value").agg(F.count("*").alias("n"))
    every = Window.partitionBy("column")
    ranked = counts.withColumn("freq", F.col("n") / F.sum("n").over(every)).filter(F.col("value").isNotNull())
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("column", "value", "freq", "rank")


def histogram(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, low, high, n, ndv) of an equi-depth histogram of a numeric or time column.

    Bounds are approximate percentiles from mergeable sketches, so the column is never sorted as a whole.
    """
    c = F.col(f"`{column}`")
    value = c.cast("double") if dict(df.dtypes)[column] not in ("timestamp_ntz", "timestamp", "date") else F.unix_micros(c.cast("timestamp")).cast("double")
    v = df.filter(c.isNotNull()).select(value.alias("v"))
    cuts = v.agg(F.array_distinct(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 10_000)).alias("cuts"))
    placed = v.crossJoin(F.broadcast(cuts)).withColumn("bucket", F.size(F.filter("cuts", lambda x: x < F.col("v"))))
    return placed.groupBy("bucket").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"), F.count_distinct("v").alias("ndv"))


@dataclass
class ColumnStats:
    n_rows: int
    null_frac: float
    ndv: int
    common: dict[str, float] = field(default_factory=dict)
    bounds: list[tuple[float, float, int]] = field(default_factory=list)

    def equals(self, value: object) -> float:
        """Share of rows that equal a value."""
        if str(value) in self.common:
            return self.common[str(value)]
        left = max(0, self.ndv - len(self.common))
        return max(0.0, 1 - self.null_frac - sum(self.common.values())) / left if left else 0.0

    def below(self, value: float) -> float:
        """Share of rows that are at most a number."""
        total = sum(n for *_, n in self.bounds)
        got = sum(n if high <= value else 0 if low > value else n * (value - low) / (high - low) for low, high, n in self.bounds)
        return got / total * (1 - self.null_frac) if total else 0.0

    def like(self, pattern: str) -> float:
        """Share of rows that match a LIKE pattern: from the common values, and a guess for the rest."""
        rx = re.compile("".join({"%": ".*", "_": "."}.get(ch, re.escape(ch)) for ch in pattern), re.S)
        return min(1.0, sum(f for v, f in self.common.items() if rx.fullmatch(v)) + 0.05 * max(0.0, 1 - self.null_frac - sum(self.common.values())))


def column_stats(df: DataFrame, column: str) -> ColumnStats:
    """All statistics of one column; results are bounded by COMMON and BUCKETS."""
    r = analyze(df, [column]).first()
    common = {x["value"]: x["freq"] for x in common_values(df, [column]).collect()}
    numeric = dict(df.dtypes)[column] not in ("string", "boolean")
    bounds = sorted((x["low"], x["high"], x["n"]) for x in histogram(df, column).collect()) if numeric else []
    return ColumnStats(r["n_rows"], r["null_frac"], r["ndv"], common, bounds)


def save_stats(stats: dict[str, dict[str, ColumnStats]], path: str) -> None:
    """Statistics by table and column, as JSON."""
    with open(path, "w") as f:
        json.dump({t: {c: asdict(s) for c, s in cols.items()} for t, cols in stats.items()}, f)


def load_stats(path: str) -> dict[str, dict[str, ColumnStats]]:
    with open(path) as f:
        got = json.load(f)
    return {t: {c: ColumnStats(**{**s, "bounds": [tuple(b) for b in s["bounds"]]}) for c, s in cols.items()} for t, cols in got.items()}


def join_rows(left: int, right: int, ndv_left: int, ndv_right: int) -> float:
    """Estimated rows of an equi-join."""
    return left * right / max(1, max(ndv_left, ndv_right))


def conjunction(shares: list[float]) -> float:
    """Share of rows that meet several independent conditions."""
    return reduce(lambda a, b: a * b, shares, 1.0)
