from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillon.llm.quality import DIM, REACH, SURE, Vectors, classified, context_sums, evidence, fit, index_entries, own_vectors, pooled, pooled_by_evidence, token_sets, tokens, train, weighted, word_vectors

from .conftest import DATA

TEXTS = ["one two, two three!! one", None, "", "a b", "ONE", "x " * 50]


def test_contexts_and_pooling_against_loops():
    w, ptr = tokens(pa.array(TEXTS))
    assert np.diff(ptr).tolist() == [7, 0, 0, 2, 1, 50]
    place, sign = index_entries(w)
    keys = np.unique(w)[1:]  # one token is below the share
    want = np.zeros((len(keys), DIM))
    for r in range(len(TEXTS)):
        for i in range(ptr[r], ptr[r + 1]):
            for j in range(max(ptr[r], i - REACH), min(ptr[r + 1], i + REACH + 1)):
                if i != j and w[i] in keys:
                    for d, s in zip(place[j], sign[j]):
                        want[list(keys).index(w[i]), d] += s
    assert np.array_equal(context_sums(w, ptr, keys), want)
    count = np.array([(w == k).sum() for k in keys])
    table = weighted(want, count, len(w))
    x = pooled(w, ptr, Vectors(keys, table))
    own = own_vectors(w)
    assert set(np.unique(own)) == {-1, 1} and len(np.unique(own_vectors(np.unique(w)), axis=0)) == len(np.unique(w))
    for r in range(len(TEXTS)):
        rows = []
        for i in range(ptr[r], ptr[r + 1]):
            v = table[list(keys).index(w[i])].astype(float) if w[i] in keys else np.r_[np.zeros(DIM), 1.0]
            rows.append(np.r_[v[:-1], own[i] * v[-1] / np.sqrt(DIM), v[-1]])
        rows = np.array(rows)
        mean = rows[:, :-1].sum(0) / rows[:, -1].sum() if len(rows) else np.zeros(2 * DIM)
        assert np.allclose(x[r], [*mean, np.linalg.norm(mean[:DIM]), np.linalg.norm(mean[DIM:]), np.log1p(len(rows))], atol=1e-5)


def test_the_table_covers_all_documents(spark, edge_docs):
    w, ptr = tokens(pa.array([r.text for r in edge_docs.collect()]))
    keys, n = np.unique(w, return_counts=True)
    for share in (0, 1.5 / len(w)):
        v = word_vectors(edge_docs, share=share)
        some = n >= share * len(w)
        assert np.array_equal(v.keys, keys[some]) and 0 < some.sum() and (share == 0) == some.all()
        assert np.allclose(v.table, weighted(context_sums(w, ptr, keys[some]), n[some], len(w)), atol=1e-6)


def test_evidence_against_loops():
    rng = np.random.default_rng(4)
    keys = np.sort(rng.integers(1, 1 << 63, 30).astype(np.uint64))
    docs = [rng.choice(keys, rng.integers(0, 12)) for _ in range(200)] + [rng.integers(1, 1 << 63, 3).astype(np.uint64)]
    w, ptr = np.concatenate(docs), np.r_[0, np.cumsum([len(d) for d in docs])]
    y = np.stack([[float(keys[3] in d) for d in docs], np.where(rng.random(201) < 0.5, np.nan, 1.0)], 1)
    at, ends = token_sets(w, ptr, keys)
    assert [set(at[a:b].tolist()) for a, b in zip(ends, ends[1:])] == [{list(keys).index(t) if t in keys else 30 for t in d} for d in docs]
    proof = evidence(at, ends, y, 30)
    for i, key in enumerate(keys):
        a, b = (sum(key in d and v == k for d, v in zip(docs, y[:, 0])) + 0.5 for k in (1, 0))
        r = np.log(a / (sum(y[:, 0]) + 1)) - np.log(b / (201 - sum(y[:, 0]) + 1))
        assert np.isclose(proof[i, 0], np.sign(r) * max(0, abs(r) - SURE * np.sqrt(1 / a + 1 / b)))
    assert proof[:, 0].argmax() == 3 and not proof[30].any()
    x = pooled_by_evidence(at, ends, proof, keys)
    own = own_vectors(keys)
    for r, d in enumerate(docs):
        e = {t: proof[list(keys).index(t), 0] for t in set(d.tolist()) if t in keys}
        total = sum((v * own[list(keys).index(t)] for t, v in e.items()), np.zeros(DIM)) / (1 + sum(map(abs, e.values())))
        assert np.allclose(x[r, :DIM], total, atol=1e-5) and np.isclose(x[r, DIM], np.log1p(sum(max(v, 0) for v in e.values())))


def test_network_and_temperature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 10))
    p = 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))  # not linear
    y = np.stack([rng.random(4000) < p, np.where(rng.random(4000) < 0.5, np.nan, x[:, 2] > 0)], 1).astype(float)
    net = fit(x[:3000], y[:3000])
    q = net(x[3000:])
    assert ((q[:, 0] > 0.5) == (p[3000:] > 0.5)).mean() > 0.85 and ((q[:, 1] > 0.5) == (x[3000:, 2] > 0)).mean() > 0.95
    for low in (0.1, 0.4, 0.7):  # the probabilities are about right
        part = (q[:, 0] > low) & (q[:, 0] < low + 0.2)
        assert abs(y[3000:, 0][part].mean() - q[part, 0].mean()) < 0.12


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for_test = F.pmod(F.hash("doc_id"), F.lit(3)) == 0
    model = train(docs, labels.filter(~for_test))
    out = classified(docs, model).join(labels.filter(for_test), "doc_id").toPandas()
    good, toxic = out.quality == 1, out.toxic == 1
    assert toxic.sum() > 100 and (good & toxic).sum() > 80
    assert (out.keep == (good & ~toxic)).mean() > 0.94
    assert out[good & ~toxic].keep.mean() > 0.96 and (~out[good & toxic].keep).mean() > 0.88


def test_edges(spark, edge_docs):
    labels = spark.createDataFrame([(4, 1, None), (6, 0, 1), (6, 0, 0), (None, 1, 1), (1, 1, 1), (77, None, None)], "doc_id long, quality int, toxic int")
    out = classified(edge_docs, train(edge_docs, labels)).collect()
    assert len(out) == edge_docs.count()
    for r in out:
        assert (r.p_quality is None) == (r.p_toxic is None) and (r.p_quality is not None or not r.keep)
    none = train(edge_docs, labels.limit(0))
    assert none.net is None and all(r.p_quality is None for r in classified(edge_docs, none).collect())
    assert classified(edge_docs.limit(0), none).count() == 0 and train(edge_docs.limit(0), labels).net is None
    assert spark.read.parquet(f"{DATA}/documents.parquet").count()
