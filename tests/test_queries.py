from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

from quillon.plans import load
from quillon.session import TABLES

from .conftest import DATA

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
    return str(x)


def rows(cols: list[str], data) -> list[tuple]:
    by = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    return sorted(tuple(plain(r[i]) for i in by) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    res = duck.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    want = rows(cols, res.fetchall())
    assert sorted(c.lower() for c in cols) == sorted(c.lower() for c in df.columns)
    assert got == want
    kinds = {d[0].lower(): str(d[1]) for d in res.description}
    for c, t in df.dtypes:  # the same kind of type
        d = kinds[c.lower()]
        same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
        assert d == same.get(t, d), (c, t, d)
