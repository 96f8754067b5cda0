"""Benchmark decontamination by a BM25 index of test items.

The items are the index and every passage of every document is a query. Items of more than SEGMENT words are indexed in parts. Scores
are BM25 with each distinct word of the passage counted once, divided by the score that the part gets from its own words, so THRESHOLD is
the share of a part's weight that a passage must hold. Passages are windows of twice SEGMENT words, one SEGMENT apart, so some window holds
any run of words that a part can have.

Retrieval is a batch form of block-max WAND, for all passages of a batch at once instead of one cursor for each list, and gives exactly the pairs of passage and part at THRESHOLD or above:
1. the lists of rare words play the pivot's part: they bound every part's score, and passages that no part can reach with them go; 2. the largest impact of each block of
each list bounds the scores by block, and of blocks that stay below no posting is read; 3. what is left is scored in full.

A pair counts when the words around the passage hold at least OVERLAP of the n-grams of both the item's question and its answer. The answer
is what follows the last question mark or, where nothing does, the last sentence; of a lone sentence it is the last third. An item of fewer than WHOLE_WORDS words has too few
n-grams for shares to tell anything; of it the whole run of words must stand in the document.

The items are held by the driver; their indexes are sent to the executors PASS_BYTES of text at a time, and each pass over the documents searches all of these.

Cases: null and empty texts have no passages. Items that are null, without an id or without a word are in no index. Repeated rows are searched one by one. Texts are read whole, whatever their length. Other columns pass through untouched, whatever
their names; without documents or items nothing is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import U64, mix, rows_of, slices, small_batches, tidied, words

SEGMENT = 64
THRESHOLD = 0.5
OVERLAP = 0.5
NGRAM = 4
WHOLE_WORDS = 6
K1, B = 1.2, 0.75
BLOCK = 16
RARE = 0.85  #: share of a part's weight that the lists of the first step hold
SHARD_BYTES = 16 << 20  #: text of items in one index
PASS_BYTES = 64 << 20  #: text of items whose indexes go to the executors together
_BITS = 20


@dataclass
class Index:
    ids: np.ndarray  # of the items
    grams: list[tuple[np.ndarray, np.ndarray]]  # of each item's question and answer
    length: np.ndarray  # words of each item
    item: np.ndarray  # of each part
    terms: np.ndarray  # sorted hashes
    ptr: np.ndarray  # postings of each term
    part: np.ndarray
    weight: np.ndarray
    rare: np.ndarray  # whether a posting is in the lists of the first step
    need: np.ndarray  # what these lists must give for a part
    least: np.ndarray  # the score that a part must have
    seen: np.ndarray  # low bits of the terms of the first step


def question_and_answer(text: str) -> tuple[str, str]:
    """The two halves of an item; a lone sentence has its last third as the answer."""
    text = text.strip()
    at = text.rfind("?") + 1
    if not at or not re.search(r"\w", text[at:]):
        ends = [m.end() for m in re.finditer(r"[.!?\n]+(?=\s|$)\s*", text) if re.search(r"\w", text[m.end() :])]
        at = ends[-1] if ends else 0
    if at and re.search(r"\w", text[:at]):
        return text[:at], text[at:]
    parts = list(re.finditer(r"\S+", text))
    cut = parts[-max(1, len(parts) // 3)].start() if parts else 0
    return text[:cut], text[cut:]


def ngrams(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(w) < n:
        return np.zeros(0, U64)
    h = np.full(len(w) - n + 1, n, U64)
    for k in range(n):
        h = mix(h + w[k : len(w) - n + 1 + k])
    return h


def grams_of(text: str) -> tuple[np.ndarray, int]:
    """The n-grams of a question or answer and their n, which is less for a short one."""
    w = words(pa.array([text]))[0]
    n = max(1, min(NGRAM, len(w)))
    return np.unique(ngrams(w, n)), n


def build_indexes(items: list[tuple[int, str | None]], shard_bytes: int = SHARD_BYTES) -> list[Index]:
    """Indexes of all items, each of about shard_bytes of text; frequencies are those of all items together."""
    items = [(i, t) for i, t in items if i is not None and t]
    w, ptr, _, _ = words(pa.array([t for _, t in items], pa.large_string()))
    count = np.diff(ptr)
    items = [(i, t, w[a : a + n]) for (i, t), a, n in zip(items, ptr, count) if n]
    count = count[count > 0]
    if not items:
        return []
    cuts = -(-count // SEGMENT)
    item = np.repeat(np.arange(len(items)), cuts)
    nth = np.arange(len(item)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    first = (np.cumsum(count) - count)[item] + count[item] * nth // cuts[item]
    size = np.diff(np.r_[first, len(w)])
    of = np.repeat(np.arange(len(item)), size)
    order = np.lexsort([w, of])
    t, p = w[order], of[order]
    new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (p[1:] != p[:-1])])
    t, p, f = t[new], p[new], np.diff(np.r_[new, len(t)])
    _, at, df = np.unique(t, return_inverse=True, return_counts=True)
    df = df[at]
    weight = np.log(1 + (len(item) - df + 0.5) / (df + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size[p] / size.mean()))
    weight /= np.bincount(p, weight)[p]
    by = np.lexsort([t, df, p])
    before = np.cumsum(weight[by]) - weight[by]
    head = np.flatnonzero(np.r_[True, p[by][1:] != p[by][:-1]])
    rare = np.empty(len(t), bool)
    rare[by] = before - np.repeat(before[head], np.diff(np.r_[head, len(t)])) < RARE
    least = np.where(count[item] < WHOLE_WORDS, 1.0, THRESHOLD) - 1e-9
    need = least - (1 - np.bincount(p, weight * rare, len(item))) - 1e-9
    shard = (np.cumsum([len(x[1]) for x in items]) - len(items[0][1])) // shard_bytes
    out = []
    for k in np.unique(shard):
        mine, parts = np.flatnonzero(shard == k), np.flatnonzero(shard[item] == k)
        on = np.flatnonzero((p >= parts[0]) & (p <= parts[-1]))
        on = on[np.lexsort([p[on], t[on]])]
        terms, begin = np.unique(t[on], return_index=True)
        seen = np.zeros(1 << _BITS, bool)
        seen[(t[on][rare[on]] & U64((1 << _BITS) - 1)).astype(np.int64)] = True
        grams = []
        for x in (items[i] for i in mine):
            whole = (ngrams(x[2], len(x[2])), len(x[2]))
            grams.append((whole, whole) if len(x[2]) < WHOLE_WORDS else tuple(map(grams_of, question_and_answer(x[1]))))
        ids = np.array([items[i][0] for i in mine], np.int64)
        out.append(Index(ids, grams, count[mine], item[parts] - mine[0], terms, np.r_[begin, len(on)], p[on] - parts[0], weight[on], rare[on], need[parts], least[parts], seen))
    return out


def _expand(ptr: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings of each term in a list, and which of the list each belongs to."""
    n = ptr[term + 1] - ptr[term]
    of = np.repeat(np.arange(len(term)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + ptr[term][of], of


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inv = np.unique(key, return_inverse=True)
    return keys, np.bincount(inv, value, len(keys))


def _distinct_terms(ix: Index, w: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of window and term."""
    at = np.minimum(np.searchsorted(ix.terms, w), len(ix.terms) - 1)
    ok = ix.terms[at] == w
    pair = np.unique(window[ok] * len(ix.terms) + at[ok])
    return pair // len(ix.terms), pair % len(ix.terms)


def retrieve(ix: Index, w: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, part, score) of all passages and parts at THRESHOLD or above, of rows of hashed words."""
    n_parts, n_blocks = len(ix.need), -(-len(ix.need) // BLOCK)
    row = rows_of(ptr)
    pos = np.arange(len(w)) - ptr[:-1][row]
    # windows are numbered by row and SEGMENT; each word is in the one that begins at its segment and the one before
    base = np.r_[0, np.cumsum(-(-np.diff(ptr) // SEGMENT))]
    seg = base[:-1][row] + pos // SEGMENT
    hit = np.flatnonzero(ix.seen[(w & U64((1 << _BITS) - 1)).astype(np.int64)])
    earlier = hit[pos[hit] >= SEGMENT]
    win, term = _distinct_terms(ix, np.r_[w[hit], w[earlier]], np.r_[seg[hit], seg[earlier] - 1])
    p, of = _expand(ix.ptr, term)
    lists = ix.rare[p]
    key, got = _sums(win[of][lists] * n_parts + ix.part[p[lists]], ix.weight[p[lists]])
    alive = np.unique((key // n_parts)[got >= ix.need[key % n_parts]])
    if (free := ix.need <= 0).any() and len(base) > 1:  # parts that common words alone could reach
        alive = np.arange(base[-1]) if free.any() else alive
    if not len(alive):
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(float)
    on = np.zeros(base[-1] + 1, bool)
    on[alive] = True
    a, b = np.flatnonzero(on[seg]), np.flatnonzero((pos >= SEGMENT) & on[seg - 1])
    win, term = _distinct_terms(ix, np.r_[w[a], w[b]], np.r_[seg[a], seg[b] - 1])
    blocks, bptr, most, postings, lowest = _block_max(ix, n_blocks)
    p, of = _expand(bptr, term)
    key, bound = _sums(win[of] * n_blocks + blocks[p], most[p])
    opened = np.isin(win[of] * n_blocks + blocks[p], key[bound >= lowest[key % n_blocks]])
    p, of = p[opened], of[opened]
    q, inner = _expand(postings, p)  # only the postings of these blocks
    key, score = _sums(win[of[inner]] * n_parts + ix.part[q], ix.weight[q])
    ok = score >= ix.least[key % n_parts]
    win, part, score = key[ok] // n_parts, key[ok] % n_parts, score[ok]
    r = np.searchsorted(base, win, "right") - 1
    return r, (win - base[r]) * SEGMENT, part, score


def _block_max(ix: Index, n_blocks: int) -> tuple[np.ndarray, ...]:
    """The lists of (block, largest weight) of all terms, where the postings of each entry begin, and the least score that counts in each block."""
    if not hasattr(ix, "_most"):
        term = rows_of(ix.ptr)
        key = term * n_blocks + ix.part // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        most = np.maximum.reduceat(ix.weight, first)
        k = key[first]
        lowest = np.minimum.reduceat(ix.least, np.arange(0, len(ix.least), BLOCK))
        ix._most = k % n_blocks, np.searchsorted(k // n_blocks, np.arange(len(ix.terms) + 1)), most, np.r_[first, len(key)], lowest
    return ix._most


def contaminated(ix: Index, column: pa.Array) -> dict[tuple[int, int], tuple[float, float, float]]:
    """{(row, item): (score, question overlap, answer overlap)} of the verified pairs of a column of texts."""
    w, ptr, _, _ = words(column)
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    if not len(w):
        return out
    for r, s, part, score in zip(*retrieve(ix, w, ptr)):
        item = int(ix.item[part])
        extra = int(ix.length[item])
        around = w[max(ptr[r], ptr[r] + s - extra) : min(ptr[r + 1], ptr[r] + s + 2 * SEGMENT + extra)]
        q, a = (float(np.isin(g, ngrams(around, n)).mean()) for g, n in ix.grams[item])
        if q >= OVERLAP and a >= OVERLAP:
            out[int(r), item] = max(out.get((int(r), item), (0.0, 0.0, 0.0)), (float(score), q, a))
    return out


def _indexes(benchmark: DataFrame, item_col: str, text_col: str) -> list:
    """Broadcasts of the indexes that one pass searches."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).orderBy(item_col, text_col).toLocalIterator()
    every, each = build_indexes([tuple(r) for r in items]), PASS_BYTES // SHARD_BYTES
    return [spark.sparkContext.broadcast(every[k : k + each]) for k in range(0, len(every), each)]


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each document and the item that it holds, with the best passage's figures."""
    small_batches(docs.sparkSession)

    def searcher(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in tidied(batches):
                for b, ix in ((b, ix) for b in slices(big, "__text") for ix in sent.value):
                    got = contaminated(ix, b.column(1))
                    ids = b.column(0).take(pa.array([r for r, _ in got], pa.int64()))
                    figures = list(zip(*got.values())) or [[], [], []]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(ix.ids[[i for _, i in got]] if got else [], pa.int64()), *(pa.array(f, pa.float64()) for f in figures)], [id_col, item_col, "score", "question_overlap", "answer_overlap"])

        return run

    texts = docs.select(id_col, F.col(text_col).alias("__text"))
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, `{item_col}` long, score double, question_overlap double, answer_overlap double"
    found = [texts.mapInArrow(searcher(sent), schema) for sent in _indexes(benchmark, item_col, item_text_col)]
    if not found:
        return texts.select(id_col, *(F.lit(None).cast(t).alias(c) for c, t in ((item_col, "long"), ("score", "double"), ("question_overlap", "double"), ("answer_overlap", "double")))).limit(0)
    out = found[0]
    for other in found[1:]:
        out = out.unionAll(other)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns; no shuffle."""
    small_batches(docs.sparkSession)
    schema = docs.schema

    def cleaner(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in tidied(batches):
                for b in slices(big, text_col):
                    gone = np.zeros(b.num_rows, bool)
                    for ix in sent.value:
                        gone[[r for r, _ in contaminated(ix, b.column(b.schema.get_field_index(text_col)))]] = True
                    yield b.filter(pa.array(~gone))

        return run

    for sent in _indexes(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(cleaner(sent), schema)
    return docs
