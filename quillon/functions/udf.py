"""Registration of user functions for SQL text and expression strings."""

from __future__ import annotations

import inspect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

RESULTS = {int: "bigint", float: "double", str: "string"}


def register(spark: SparkSession, name: str, fn: Callable, result: type | None = None, deterministic: bool = True) -> Callable:
    """Make a function of up to three arguments callable by name; its result is an int, float or str.

    It runs over Arrow batches. A call with another number of arguments is an error when the query is analysed. Null arguments reach
    the function as None.
    """
    n = len(inspect.signature(fn).parameters)
    result = result or inspect.signature(fn).return_annotation
    result = {"int": int, "float": float, "str": str}.get(result, result) if isinstance(result, str) else result
    if n > 3 or result not in RESULTS:
        raise TypeError("a function has up to three arguments and gives an int, a float or a str")
    made = F.udf(fn, RESULTS[result], useArrow=True)
    made = made if deterministic else made.asNondeterministic()
    return spark.udf.register(name, made)


def register_vectorized(spark: SparkSession, name: str, fn: Callable[..., pd.Series], result: type) -> Callable:
    """The same for a function over whole pandas series."""
    return spark.udf.register(name, F.pandas_udf(fn, RESULTS[result]))


def register_aggregate(spark: SparkSession, name: str, fn: Callable[[pd.Series], float], result: type) -> Callable:
    """An aggregate of user code: a whole group's values as one series, one result."""

    def agg(x: pd.Series) -> float:
        return fn(x)

    agg.__annotations__ = {"x": pd.Series, "return": result}
    return spark.udf.register(name, F.pandas_udf(agg, RESULTS[result]))
