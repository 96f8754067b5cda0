from __future__ import annotations

import corpus_pipeline
from quillon.llm.compression import compression_report
from quillon.llm.decontaminate import benchmark_leaks
from quillon.llm.near import near_groups

from .conftest import DATA
from .test_packing import check
from .test_repeats import brute
from quillon.llm.tokens import token_counts


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        steps.append((docs, out.cache()))
        assert name == names[-1] or out.columns == docs.columns
        docs = out
    (a, b), (_, c), (_, d), (_, e), (_, f) = steps
    assert ids(b) == {r.doc_id for r in compression_report(a).collect() if r.keep}
    assert ids(b) - ids(c) == {r.doc_id for r in near_groups(b).collect() if not r.keep}
    gone = brute([(r.doc_id, r.text) for r in c.collect()], 50)
    assert {r.doc_id for r in c.exceptAll(d).collect()} == set(gone)
    leaks = benchmark_leaks(d, spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert ids(d) - ids(e) == ids(leaks)
    assert len(ids(a)) > len(ids(b)) > len(ids(c)) >= len(ids(d)) > len(ids(e)) > 0.6 * len(ids(a))
    rows = f.collect()
    check(rows, {r.doc_id: r.n_tokens for r in token_counts(e).collect()}, 2048)
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, rows))


def test_edges(spark, edge_docs, tmp_path):
    spark.createDataFrame([(1, "nothing of this stands anywhere at all, does it?")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (edge_docs, edge_docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.count()
