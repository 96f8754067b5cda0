from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


DATA = "/root/testdata/sf0.01"
EDGES = "doc_id long, text string, lang string, source string, n_chars long, doc string, n int, key long, `group_id` string"


@pytest.fixture
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows and columns with names that the operators use inside."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "one"), (5, "one"), (None, "a row without an id"), (6, long), (7, long), (8, "x" * 300_000), (9, "tag 🙂 é中文 \x00 end"), (None, None)]
    return spark.createDataFrame([(i, t, None, None, None, "d", 1, None, "g") for i, t in texts], EDGES)
