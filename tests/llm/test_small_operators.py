from __future__ import annotations

import random

import pytest
import zstandard
from tokenizers import Tokenizer

from quillon.llm.compression import BANDS, CHUNK_BYTES, compression_filter, compression_report, judge, out_of_band
from quillon.llm.shared import shared_dir, with_ids, words, written
from quillon.llm.tokens import VOCABULARY, counted, encoder, pieces, token_counts

from .conftest import DATA


@pytest.fixture(scope="module")
def enc():
    with open(VOCABULARY, "rb") as f:
        return encoder(f.read(), VOCABULARY)


def test_counts_against_whole_texts(spark, enc):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in token_counts(docs).collect()}
    other = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    for i, r in enumerate(docs.collect()):
        assert got[r.doc_id].n_tokens == len(enc.encode_ordinary(r.text)) and got[r.doc_id].n_bytes == len(r.text.encode())
        if i % 20 == 0:
            assert got[r.doc_id].n_tokens == len(other.encode(r.text, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(30))
def test_pieces_are_safe(enc, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "Z", "é", "7", " ", "  ", "\n", "\t", "'s", "'ll", "'", "!", "🙂", "中", " ", " ", "_", ". ", "word "]) for _ in range(3000))
    for most in (1, 5, 40, 700):
        cut = list(pieces(text, most))
        assert "".join(cut) == text
        assert sum(len(enc.encode_ordinary(p)) for p in cut) == len(enc.encode_ordinary(text))
    texts = [text, None, "", text[:50], "x" * 5000]
    assert counted(texts, enc, 100, 10) == [None if t is None else len(enc.encode_ordinary(t)) for t in texts]


def test_compression_against_plain(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in compression_filter(docs).collect()}
    for r in compression_report(docs).collect():
        data = next(d.text for d in _cache(docs) if d.doc_id == r.doc_id).encode()
        assert r.n_bytes == len(data) and r.ratio == len(data) / len(zstandard.ZstdCompressor(level=3).compress(data))
        assert r.keep == (r.doc_id in kept) == (r.verdict == "keep") and r.n_chunks == -(-len(data) // CHUNK_BYTES)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1")
    good = [r.doc_id for r in labels.collect()]
    assert sum(d in kept for d in good) >= 0.995 * len(good)


_DOCS: list = []


def _cache(docs):
    if not _DOCS:
        _DOCS.extend(docs.select("doc_id", "text").collect())
    return _DOCS


def test_bands():
    prose = ("The committee met on Tuesday to weigh the proposal. " "Nobody could say who had written it, yet all agreed that the bridge needed paint before winter, and that the ferry would have to wait. ").encode()
    assert judge(prose)[-1]
    assert judge(b"spam " * 400)[-2] == "repetitive"
    rng = random.Random(0)
    assert judge(bytes(rng.randrange(256) for _ in range(3000)))[-2] == "incompressible"
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    mixed = "".join(rng.choice(["river ", "stone ", "walks ", "under ", "seven ", "lamps "]) + rng.choice(alphabet) for _ in range(1500)).encode()
    noise = "".join(rng.choice(alphabet) for _ in range(2 * CHUNK_BYTES)).encode()
    assert judge(mixed[: 2 * CHUNK_BYTES] + noise)[-2] == "incompressible"  # the whole text's ratio is inside its band
    assert judge(b"") == judge(None) == (0, None, 0, None, None, "empty", False)
    assert out_of_band(1.0, 10) == 0 and all(low < high for _, low, high in BANDS)


def test_edges(spark, edge_docs):
    n = edge_docs.count()
    report = compression_report(edge_docs).collect()
    assert len(report) == n and [r.verdict for r in report if r.doc_id == 1] == ["empty"]
    assert {r.doc_id for r in report if r.verdict == "repetitive"} == {6, 7, 8}  # counted words compress well
    left = compression_filter(edge_docs)
    assert left.columns == edge_docs.columns and left.count() == sum(r.keep for r in report)
    counts = token_counts(edge_docs).collect()
    assert len(counts) == n and {r.n_tokens for r in counts if r.doc_id == 1} == {None} and {r.n_tokens for r in counts if r.doc_id == 2} == {0}
    for f in (compression_report, compression_filter, token_counts):
        assert f(edge_docs.limit(0)).count() == 0


def test_ids_by_array_and_by_join(spark, edge_docs):
    ids = spark.createDataFrame([(4,), (6,), (99,)], "k long")
    for most in (0, 1 << 20):
        assert sorted(r.doc_id for r in with_ids(edge_docs, ids, True, most_bytes=most).collect()) == [4, 6]
        assert with_ids(edge_docs, ids, False, most_bytes=most).count() == edge_docs.count() - 2
        assert with_ids(edge_docs, ids.limit(0), False, most_bytes=most).count() == edge_docs.count()
        assert with_ids(edge_docs, ids.limit(0), True, most_bytes=most).count() == 0
    assert shared_dir(spark).removeprefix("file://") in written(ids, "ids").inputFiles()[0]


def test_words():
    import pyarrow as pa

    w, ptr, start, end = words(pa.array(["Ab, ab!", None, "", "É é x"]))
    assert ptr.tolist() == [0, 2, 2, 2, 5] and w[0] == w[1] and w[2] == w[3] and len(set(w.tolist())) == 3
    assert start.tolist() == [0, 4, 7, 10, 13] and end.tolist() == [2, 6, 9, 12, 14]
    long = "word " * 900_000  # more than is hashed at a time
    assert len(set(words(pa.array([long]))[0].tolist())) == 1
