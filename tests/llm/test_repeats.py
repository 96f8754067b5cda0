from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm.repeats import cut_spans, repeated_passages, without_repeats
from quillon.llm.shared import words

from .conftest import DATA


def brute(rows: list[tuple[int, str | None]], length: int) -> dict[int, set[int]]:
    """For each document the words that a window covers which stood before."""
    seen, out = {}, {}
    split = {}
    for d, t in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        w, ptr, _, _ = words(pa.array([t]))
        split[d] = w.tolist()
    for d, w in split.items():
        for i in range(len(w) - length + 1):
            if seen.setdefault(tuple(w[i : i + length]), (d, i)) != (d, i):
                out.setdefault(d, set()).update(range(i, i + length))
    return out


def covered(found) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {}
    for r in found:
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = repeated_passages(docs).collect()
    want = brute(rows, 50)
    assert want and covered(found) == want
    w = {d: words(pa.array([t]))[0].tolist() for d, t in rows}
    for r in found:  # each repeat is the same words as its first place
        n = r.end_word - r.start_word
        assert n >= 50 and w[r.doc_id][r.start_word : r.end_word] == w[r.first_doc_id][r.first_start_word : r.first_start_word + n]
        assert (r.first_doc_id, r.first_start_word) < (r.doc_id, r.start_word)
    left = {r.doc_id: r.text for r in without_repeats(docs).collect()}
    for d, t in rows:
        n = len(w[d]) - len(want.get(d, ()))
        assert (d in left) == bool(n) and (d not in left or len(words(pa.array([left[d]]))[0]) == n)
        assert d in want or left[d] == t


@pytest.mark.parametrize("seed", range(3))
def test_shifted_and_overlapping_repeats(spark, seed):
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(30, 130))] for _ in range(6)] + [["same"] * 120, ["a", "b"] * 70]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool)
            a = rng.randrange(0, 20)
            parts += p[a : len(p) - rng.randrange(0, 20)] + [f"own{rng.randrange(9999)}"] * rng.randrange(0, 4)
        rows.append((d, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert covered(repeated_passages(df).collect()) == brute(rows, 50)


def test_edges(spark, edge_docs):
    assert covered(repeated_passages(edge_docs).collect()) == {7: set(range(60_000))}
    left = without_repeats(edge_docs)
    assert left.schema.names == edge_docs.schema.names
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted("1 2 3 4 5 5 None 6 8 9 None".split())
    assert without_repeats(edge_docs.limit(0)).count() == 0


def test_a_frequent_anchor_is_spread(spark):
    """A passage of 40 words in 3,000 documents with other words around it, some of which recur, in suffix arrays of 5,000 words."""
    rng = random.Random(9)
    line = [f"licence{i}" for i in range(40)]
    around = [([f"l{rng.randrange(10**6)}" for _ in range(12)], [f"r{rng.randrange(10**6)}" for _ in range(12)]) for _ in range(700)]
    rows = []
    for d in range(3000):
        before, after = rng.choice(around)[0], rng.choice(around)[1]
        rows.append((d, " ".join([f"own{d}", *before[rng.randrange(9) :], *line, *after[: rng.randrange(3, 12)], f"own{d}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 50)
    assert len(want) > 500
    for group_words in (5000, 1 << 20):
        assert covered(repeated_passages(df, group_words=group_words).collect()) == want


def test_rows_that_share_an_id_lose_what_they_repeat(spark):
    rng = random.Random(10)
    p, q, r = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(3))
    rows = [(1, p, 1), (2, p, 2), (2, q, 3), (2, r + " " + q, 4), (2, r + " " + q, 5)]
    left = sorted(map(tuple, without_repeats(spark.createDataFrame(rows, "doc_id long, text string, v int")).collect()), key=lambda x: x[2])
    assert left[0] == (1, p, 1) and (2, p, 2) not in left
    # of the last three, the row whose words have the lower number keeps q
    assert [(t, k) for _, t, k in left[1:]] in ([(q, 3), (r, 4), (r, 5)], [(r + " " + q, 4), (r + " " + q, 5)])


def test_cut_spans():
    assert cut_spans(["A b, c d. E f"], [[(1, 3)]]) == ["A d. E f"]
    assert cut_spans(["A b, c"], [[(1, 3), (1, 2)]]) == ["A"]
    assert cut_spans(["İx b ẞy c"], [[(2, 3)]]) == ["İx b c"]
    assert cut_spans(["keep  me "], [[]]) == ["keep  me "]
    assert np.all([cut_spans(["a b"], [[(0, 2)]]) == [""]])
