from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm.langid import SMOOTH, VOCABULARY, Pieces, _hash, fit, identified, pieces_of, train, word_scores
from quillon.llm.shared import text_bytes, words

from .conftest import DATA


@pytest.fixture(scope="module")
def tiny():
    plain, start = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bc", b"\xc3\xa9a"], [b"a", b"ab", b"c"]
    p = Pieces(_hash(plain), _hash(start), (1, 2, 3), _hash([]))
    place = {("", x): int(np.searchsorted(p.plain, _hash([x])[0])) for x in plain} | {(" ", x): len(p.plain) + int(np.searchsorted(p.start, _hash([x])[0])) for x in start}
    prob = np.random.default_rng(0).random((2, p.none + 1)) ** 3
    prob[:, p.none] = 0
    return p, place, prob / prob.sum(1, keepdims=True)


def all_ways(word: bytes, place, p, prob, first=True) -> np.ndarray:
    """The sum over all segmentations, one by one."""

    def go(i: int) -> list[np.ndarray]:
        if i == len(word):
            return [np.ones(len(prob))]
        out = []
        for j in range(i + 1, len(word) + 1):
            ways = [prob[:, place["", word[i:j]]]] if ("", word[i:j]) in place else []
            if i == 0 and first:
                ways = [x * prob[:, p.space] for x in ways] + ([prob[:, place[" ", word[i:j]]]] if (" ", word[i:j]) in place else [])
            out += [x * y for x in ways for y in go(j)]
        return out

    return sum(go(0))


def test_forward_sums_all_segmentations(tiny):
    p, place, prob = tiny
    ws = [b"a", b"abc", b"abcab", b"cabbc", "éa".encode(), b"aabcabc", b"x"]
    buf = np.frombuffer(b"".join(ws), np.uint8)
    end = np.cumsum([len(w) for w in ws])
    got = word_scores(p, prob, buf, end - [len(w) for w in ws], end)
    assert np.allclose(np.exp(got), [all_ways(w, place, p, prob) for w in ws])


def test_long_words_are_summed_whole():
    """Against a plain recursion in logarithms over the vocabulary's own pieces."""
    vocabulary = open(VOCABULARY, "rb").read()
    p = pieces_of(vocabulary)
    prob = np.random.default_rng(1).random((3, p.none + 1))
    prob[:, p.none] = 0
    prob /= prob.sum(1, keepdims=True)
    where = {h: i for i, h in enumerate(p.plain.tolist())}
    heads = {h: i + len(p.plain) for i, h in enumerate(p.start.tolist())}
    ws = [w.encode() for w in ("understanding", "сегодня", "ありがとうございますということで", "我们今天在这里讨论语言识别的问题因为没有空格所以整句都是一个词" * 3, "x" * 300, "internationalization" * 20, "é")] + [bytes(range(128, 256))]
    buf = np.frombuffer(b"".join(ws), np.uint8)
    end = np.cumsum([len(w) for w in ws])
    got = word_scores(p, prob, buf, end - [len(w) for w in ws], end)
    assert max(p.lengths) > 12 and max(map(len, ws)) > 200
    for w, g in zip(ws, got):
        a = np.full((len(w) + 1, 3), -np.inf)
        a[0] = 0
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - max(p.lengths)), j):
                h = int(_hash([w[i:j]])[0])
                e = prob[:, where[h]] * (prob[:, p.space] if i == 0 else 1) if h in where else 0
                e = e + (prob[:, heads[h]] if i == 0 and h in heads else 0)
                if np.any(e):
                    a[j] = np.logaddexp(a[j], a[i] + np.log(e))
        assert np.allclose(a[-1], g, rtol=1e-9), w
    cut = word_scores(p, prob, buf, end - [len(w) for w in ws], end - 1)  # one byte less gives something else
    assert not np.isclose(cut, got).any()


def test_fifty_languages_stay_small():
    import tracemalloc

    p = pieces_of(open(VOCABULARY, "rb").read())
    prob = np.random.default_rng(2).random((50, p.none + 1))
    text = pa.array([" ".join(f"word{i}ing" for i in range(60_000)) + " " + "漢字" * 2000])
    w, _, start, end = words(text)
    tracemalloc.start()
    out = word_scores(p, prob / prob.sum(1, keepdims=True), text_bytes(text)[0], start, end)
    assert out.shape == (60_001, 50) and np.isfinite(out).all()
    assert tracemalloc.get_traced_memory()[1] < 600e6
    tracemalloc.stop()


def test_fit_raises_the_likelihood(tiny):
    p = tiny[0]
    lines = ["abc abc ab c", "ab abc a", "xyz zyx yy", "zz xy x"]
    labels = ["l1", "l1", "l2", "l2"]
    last = -np.inf
    for rounds in range(1, 9):
        langs, prob = fit(p, pa.array(lines), labels, rounds)
        assert langs == ["l1", "l2"] and np.isclose(prob.sum(1), 1).all()
        total = SMOOTH * np.log(np.delete(prob, p.none, 1)).sum()  # what the smoothing stands for
        for line, l in zip(lines, labels):
            _, _, start, end = words(pa.array([line]))
            total += word_scores(p, prob, np.frombuffer(line.encode(), np.uint8), start, end)[:, langs.index(l)].sum()
        assert total >= last - 1e-9
        last = total


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = train(docs.filter("doc_id % 2 = 0"), texts=30)
    held = docs.filter("doc_id % 2 = 1")
    out = identified(held, model).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").filter("n_chars > 40").toPandas()
    assert len(out) > 300 and (out.language == out.lang).mean() > 0.97


def test_edges(spark, edge_docs):
    model = train(spark.read.parquet(f"{DATA}/documents.parquet"), texts=5)
    out = identified(edge_docs, model).collect()
    assert len(out) == edge_docs.count()
    assert {r.language for r in out if r.n_words == 0} == {"und"} and all(r.margin is None for r in out if r.n_words == 0)
    assert all(r.language != "und" and 0 < r.probability <= 1 for r in out if r.n_words)
    clash = edge_docs.selectExpr("*", "doc_id AS __id", "'x' AS __lang", "1 AS __turn", "'k' AS `key_`", "2 AS turn")
    assert train(clash.withColumn("lang", F.lit("xx")), texts=3)[1] == ["xx"]
    none = train(edge_docs)
    assert none[1] == [] and {r.language for r in identified(edge_docs, none).collect()} == {"und"}
    assert identified(edge_docs.limit(0), model).count() == 0
