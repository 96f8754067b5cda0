from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa

from quillon.llm.decontaminate import OVERLAP, SEGMENT, benchmark_leaks, build_indexes, contaminated, decontaminated, ngrams, question_and_answer, retrieve
from quillon.llm.shared import words

from .conftest import DATA


def every_score(ix, w: np.ndarray) -> dict[tuple[int, int], float]:
    """{(first word, part): score} of all passages and parts of one row, one by one."""
    weights: dict[int, dict[int, float]] = {}
    for t in range(len(ix.terms)):
        for p in range(ix.ptr[t], ix.ptr[t + 1]):
            weights.setdefault(int(ix.part[p]), {})[int(ix.terms[t])] = float(ix.weight[p])
    out = {}
    for s in range(0, len(w), SEGMENT):
        have = set(w[s : s + 2 * SEGMENT].tolist())
        for part, of in weights.items():
            out[s, part] = sum(v for t, v in of.items() if t in have)
    return out


def test_retrieval_is_exact(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()] + [(900, "Common words of the, of the and to in is. The of and.")]
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("n_chars").limit(250).collect()] + [items[3][1], items[0][1] + " " + items[1][1]]
    for ix in build_indexes(items):
        assert np.isclose(np.bincount(ix.part, ix.weight), 1).all()
        w, ptr, _, _ = words(pa.array(texts))
        got = {(int(r), int(s), int(p)): v for r, s, p, v in zip(*retrieve(ix, w, ptr))}
        want = {(r, s, p): v for r in range(len(texts)) for (s, p), v in every_score(ix, w[ptr[r] : ptr[r + 1]]).items() if v >= ix.least[p]}
        assert got.keys() == want.keys() and len(got) > 3
        assert all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def test_leaks_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: words(pa.array([r.text]))[0] for r in bench.collect()}
    got = {(r.doc_id, r.item_id) for r in benchmark_leaks(docs, bench).collect()}
    whole = {i: set(ngrams(w, 4).tolist()) for i, w in items.items()}
    want = set()
    for r in docs.collect():
        have = set(ngrams(words(pa.array([r.text]))[0], 4).tolist())
        want |= {(r.doc_id, i) for i, g in whole.items() if g and len(g & have) >= 0.8 * len(g)}
    assert want and got == want
    left = {r.doc_id for r in decontaminated(docs, bench).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_many_shards_and_long_items():
    long = " ".join(f"term{i}" for i in range(500)) + "? " + " ".join(f"answer{i}" for i in range(20)) + "."
    items = [(1, long), (2, "What is the colour of the seventh lamp? It is a deep ultramarine."), (3, None), (None, "no id at all here, really none."), (4, "Too few."), (5, "Capital of Peru? Lima."), (6, "?!"), (2, "What is the colour of the seventh lamp? It is a deep ultramarine.")]
    noise = " ".join(f"noise{i}" for i in range(700))
    texts = pa.array([noise + " " + long + " " + noise, "x " + items[1][1].upper(), None, "", noise, "What is the colour of the seventh lamp? Nobody knows.", "So: the capital of Peru, Lima!", "Lima is the capital of Peru.", "too too few"])
    for size in (10, 1 << 24):
        found = Counter()
        for ix in build_indexes(items, size):
            for r, i in contaminated(ix, texts):
                found[r, int(ix.ids[i])] += 1
        assert set(found) == {(0, 1), (1, 2), (6, 5), (8, 4)} and max(found.values()) <= 2
    assert build_indexes([]) == [] and OVERLAP <= 1


def test_halves():
    assert question_and_answer("Why? Because.") == ("Why? ".strip(), " Because.")
    assert question_and_answer("One. Two three.\nFour five.") == ("One. Two three.\n", "Four five.")
    assert question_and_answer("a b c d e f") == ("a b c d ", "e f")


def test_edges(spark, edge_docs):
    bench = spark.createDataFrame([(1, "word0x0 word1x1 word2x2 word3x3 word4x4 word5x5 word6x6."), (2, None), (None, "x")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in benchmark_leaks(edge_docs, bench).collect()} == {(6, 1), (7, 1)}
    left = decontaminated(edge_docs, bench)
    assert left.columns == edge_docs.columns and left.count() == edge_docs.count() - 2
    assert benchmark_leaks(edge_docs, bench.limit(0)).count() == 0 and benchmark_leaks(edge_docs.limit(0), bench).count() == 0
    assert decontaminated(edge_docs, bench.limit(0)).count() == edge_docs.count()
