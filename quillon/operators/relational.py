"""Relational operators that need more than one call of the DataFrame API."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size, after pruning; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a hint to broadcast it, if it is estimated to be small enough; else Catalyst and AQE choose."""
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def derived(df: DataFrame, alias: str, *names: str) -> DataFrame:
    """A derived table: the first columns under new names, as many as names are given, all columns without any."""
    if len(names) > len(df.columns):
        raise ValueError(f"{alias} has {len(df.columns)} columns, {len(names)} names are given")
    cols = [F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)] if names else ["*"]
    return df.select(*cols).alias(alias)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """The first n rows, n being positive, after `offset` others."""
    if n <= 0:
        raise ValueError("limit must be positive")
    return (df.offset(offset) if offset else df).limit(n)


def top_k(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """The first n rows of an order; every task keeps n rows at most."""
    return limit(df.orderBy(*keys), n)


def mark_join(left: DataFrame, right: DataFrame, on: Column, mark: str = "mark") -> DataFrame:
    """Every row of left, and whether some row of right meets the condition, in which columns of left are marked with outer().

    Catalyst makes it one existence join; rows of left aren't multiplied.
    """
    return left.select("*", right.where(on).exists().alias(mark))


def single_join(left: DataFrame, right: DataFrame, keys: list[str], value: str, alias: str | None = None) -> DataFrame:
    """Every row of left with the one value that right has for its keys, null for none; more than one is an error."""
    n = F.count("*").alias("__n")
    one = right.groupBy(*keys).agg(F.first(value).alias(alias or value), n)
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one row returned by a subquery used as an expression"))).otherwise(F.col(alias or value))
    return left.join(one, keys, "left").withColumn(alias or value, checked).drop("__n")


def null_safe_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """An equi-join in which null equals null."""
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return left.join(right, cond, how)


def set_ops(first: DataFrame, *rest: tuple[str, DataFrame]) -> DataFrame:
    """Set operations strictly from left to right; names come from the first branch and the numbers of columns must match."""
    out = first
    for op, df in rest:
        if len(df.columns) != len(out.columns):
            raise ValueError("set operations need matching column count")
        df = df.toDF(*out.columns)
        match op.lower():
            case "union all":
                out = out.unionAll(df)
            case "union":
                out = out.union(df).distinct()
            case "intersect":
                out = out.intersect(df)
            case "intersect all":
                out = out.intersectAll(df)
            case "except":
                out = out.subtract(df)
            case "except all":
                out = out.exceptAll(df)
            case _:
                raise ValueError(f"unknown set operation {op!r}")
    return out


def sample_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n rows drawn uniformly without putting back; tasks keep n rows each and no row is sorted twice."""
    return limit(df.orderBy(F.rand(seed) if seed is not None else F.rand()), n)


def sample_percent(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """Each row with a chance of `percent` in a hundred."""
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and up to 100")
    return df.sample(fraction=percent / 100, seed=seed)


def gather(df: DataFrame) -> DataFrame:
    """All rows in one partition."""
    return df.coalesce(1)


def redistribute(df: DataFrame, keys: Iterable[str | Column], n: int | None = None) -> DataFrame:
    """Rows with equal keys in the same partition."""
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def round_robin(df: DataFrame, n: int) -> DataFrame:
    """Rows spread evenly."""
    return df.repartition(n)


def salted_join(big: DataFrame, other: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join on a skewed key of the first side: its rows are spread over `salts` keys and the other side is repeated for each.

    AQE parts skewed partitions of sort-merge joins by itself; this is for keys that already overwhelm one shuffle partition.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the first side must be the one that is kept")
    a = big.withColumn("__salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in big.columns)), F.lit(salts)))
    b = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return a.join(b, [key, "__salt"], how).drop("__salt")
