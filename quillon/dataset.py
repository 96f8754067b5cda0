"""A fluent interface by expression strings, over tables by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DataSet:
    df: DataFrame

    def filter(self, condition: str) -> DataSet:
        return DataSet(self.df.filter(condition))

    def join(self, other: DataSet, condition: str, how: str = "inner") -> DataSet:
        return DataSet(self.df.join(other.df, F.expr(condition), how))

    def select(self, *expressions: str) -> DataSet:
        return DataSet(self.df.selectExpr(*expressions))

    def group(self, *keys: str) -> Grouped:
        return Grouped(self.df, keys)

    def order(self, *keys: str) -> DataSet:
        """Keys may end with asc or desc; nulls come first in ascending and last in descending order."""
        cols = [F.desc(k[:-5].strip()) if k.lower().endswith(" desc") else F.asc(k[:-4].strip() if k.lower().endswith(" asc") else k) for k in keys]
        return DataSet(self.df.orderBy(*cols))

    def limit(self, n: int) -> DataSet:
        from quillon.operators.relational import limit

        return DataSet(limit(self.df, n))

    def show(self) -> list[Row]:
        return self.df.collect()


@dataclass(frozen=True)
class Grouped:
    df: DataFrame
    keys: tuple[str, ...]

    def agg(self, *expressions: str) -> DataSet:
        return DataSet(self.df.groupBy(*map(F.expr, self.keys)).agg(*map(F.expr, expressions)))


@dataclass(frozen=True)
class SQLContext:
    spark: SparkSession

    def read(self, name: str) -> DataSet:
        """A table or view, under its own name as an alias."""
        return DataSet(self.spark.table(name).alias(name))

    def register(self, name: str, fn, result: type | None = None):
        from quillon.functions.udf import register

        return register(self.spark, name, fn, result)
