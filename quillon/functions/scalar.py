"""Scalar and aggregate expressions whose semantics differ from Spark's own; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column as _C

ColumnOrName = Column | str
ORIGIN_SECONDS = 315_532_800  #: 1980-01-01, from which tumbling windows are counted


def _c(x: ColumnOrName) -> Column:
    return x if isinstance(x, _C) else F.col(x)


def int_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Quotient of whole numbers without its fraction; division by zero is an error."""
    return F.call_function("div", _c(a), _c(b))


def int_avg(x: ColumnOrName) -> Column:
    """Average of whole numbers without its fraction; null for no values."""
    return F.call_function("div", F.sum(_c(x)), F.nullif(F.count(_c(x)), F.lit(0)))


def substr_between(s: ColumnOrName, start: int, end: int) -> Column:
    """Characters start to end, both counted from 1 and both included."""
    return F.substring(_c(s), start, max(0, end - start + 1))


def round_half_even(x: ColumnOrName, digits: int = 0) -> Column:
    """Rounding in which a half goes to the even neighbour."""
    return F.bround(_c(x), digits)


def concat_or_empty(*xs: ColumnOrName) -> Column:
    """Concatenation in which null counts as the empty string."""
    return F.concat(*(F.coalesce(_c(x).cast("string"), F.lit("")) for x in xs))


def sum_strings(x: ColumnOrName, order: ColumnOrName | None = None) -> Column:
    """Concatenation of all strings of a group, in the order of a key, by default their own."""
    pairs = F.array_sort(F.collect_list(F.struct(_c(order if order is not None else x).alias("k"), _c(x).alias("v"))))
    return F.concat_ws("", F.transform(pairs, lambda p: p["v"]))


def language_order(x: ColumnOrName, collation: str = "en") -> Column:
    """A string that compares as people sort it, where lower case comes next to upper case."""
    return F.collate(_c(x), collation)


def interval_days(n: int, unit: str) -> int:
    """Days of an interval whose months have 30 days and whose years have 365."""
    return n * {"day": 1, "days": 1, "month": 30, "months": 30, "year": 365, "years": 365}[unit.lower()]


def add_interval(d: ColumnOrName, n: int, unit: str) -> Column:
    """A date so many days, 30-day months or 365-day years later."""
    return F.date_add(_c(d), interval_days(n, unit))


def value_hash(*xs: ColumnOrName) -> Column:
    """A 64-bit hash of values."""
    return F.xxhash64(*map(_c, xs))


def tumble_index(ts: ColumnOrName, seconds: int) -> Column:
    """Number of the tumbling window since the origin that holds a time."""
    epoch = F.unix_seconds(_c(ts).cast("timestamp")) - F.lit(ORIGIN_SECONDS)
    return F.floor(epoch / F.lit(seconds))


def hop_ids(ts: ColumnOrName, slide_seconds: int, seconds: int) -> Column:
    """The window numbers that hop() gives a row: its tumbling window and the next ones, one for each slide."""
    w = tumble_index(ts, seconds)
    return F.sequence(w, w + F.lit(seconds // slide_seconds - 1))


def check_comparable(df: DataFrame, left: str, right: str) -> None:
    """Raise where a string would be compared with something else."""
    kinds = [df.selectExpr(e).schema[0].dataType for e in (left, right)]
    text = [isinstance(k, T.StringType) for k in kinds]
    if text[0] != text[1] and not any(isinstance(k, T.NullType) for k in kinds):
        raise TypeError(f"no implicit conversion of character type values: {left}, {right}")
