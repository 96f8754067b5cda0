from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from quillon.llm.queries import ORACLES, QUERIES

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    res = con.execute(ORACLES[name])
    df = QUERIES[name](spark, DATA)
    assert df.columns == [d[0] for d in res.description]
    assert sorted(map(tuple, df.collect())) == sorted(res.fetchall())


def test_all_are_registered():
    names = __spark_entry__.queries().keys()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
