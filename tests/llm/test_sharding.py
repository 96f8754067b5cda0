from __future__ import annotations

import numpy as np

from quillon.llm.sharding import place, sharded
from quillon.llm.tokens import token_counts

from .conftest import DATA


def one_by_one(groups: np.ndarray, n: int, slack: float) -> list[int]:
    cap = groups.sum(0) / n * (1 + slack)
    share = [tuple(g / cap) for g in groups]
    rooms = [[1.0] * groups.shape[1] for _ in range(n)]
    out = [0] * len(groups)
    for g in sorted(range(len(groups)), key=lambda i: (-max(share[i]), -sum(share[i]), i)):
        v = share[g]
        fits = [s for s in range(n) if all(r >= x - 1e-12 for r, x in zip(rooms[s], v))] or list(range(n))
        best = max(fits, key=lambda s: (sum(r * x for r, x in zip(rooms[s], v)), -s))
        out[g] = best
        rooms[best] = [r - x for r, x in zip(rooms[best], v)]
    return out


def test_placing_against_one_by_one():
    rng = np.random.default_rng(3)
    for n in (2, 5, 9):
        g = rng.pareto(2, (80, 3)) + 0.1
        mine, plain = place(g, n), one_by_one(g, n, 0.02)
        load = lambda s: np.array([g[np.array(s) == k].sum(0) for k in range(n)])
        assert (mine == plain).mean() > 0.95 and np.allclose(load(mine).max(0), load(plain).max(0), rtol=0.05)
    g = rng.random((9000, 3))
    many = place(g, 2500)
    load = np.array([np.bincount(many, g[:, k], 2500) for k in range(3)]) / g.sum(0)[:, None] * 2500
    assert many.max() < 2500 and load.max() < 2.2


def test_documents_are_balanced(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = sharded(docs, shard_bytes=300_000).toPandas()
    counts = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs).collect()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in out.itertuples()} == counts
    n = -(-sum(b for b, _ in counts.values()) // 300_000)
    load = out.assign(rows=1).groupby("shard")[["n_bytes", "n_tokens", "rows"]].sum()
    assert sorted(load.index) == list(range(n))
    assert (load.max() / load.mean() < 1.25).all()


def test_edges(spark, edge_docs):
    out = sharded(edge_docs, shard_bytes=100_000).collect()
    assert len(out) == edge_docs.count() and len({r.shard for r in out if r.doc_id == 5}) == 1
    assert sharded(edge_docs.limit(0)).count() == 0
