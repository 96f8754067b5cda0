"""Language identification by unigram pieces, summed over all segmentations.

A language is a probability of each piece of a fixed public vocabulary. The score of a word is the sum, over all ways of cutting it into pieces, of
the product of their probabilities, by a forward recursion over its bytes; a text's is the sum of the logarithms over its words. The
probabilities come from labelled texts, TRAIN_TEXTS of each language at most (a bound on the fit alone), by expectation-maximisation over
all segmentations. Texts are scored whole; every distinct word of a batch is scored once.

Pieces are the vocabulary's tokens that have only letters and digits, in lower case, of any length, at the beginning of a word (with the space) or within it, and
all single bytes, so every word has a segmentation. Words are those of shared.py, of any length: where no piece of the vocabulary spans a place of a word, all its segmentations
part there, so the sum is the product of the sums of both sides. Words fall into such stretches, and the recursion over a stretch holds only as many states as the longest piece has bytes,
scaled as it goes. (In the fit, stretches of more than FIT_BYTES bytes aren't counted.)

Cases: texts that are null or without words get the language "und", no words and null figures. Ties go to the language that comes first in
the alphabet. Without labelled texts all are "und". Repeated rows are scored one by one. Other columns are never read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import U64, fresh, prefix, rows_of, slices, small_batches, span, text_bytes, tidied, words

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
TRAIN_TEXTS = 300
FIT_BYTES = 64
ROUNDS = 4
SMOOTH = 0.05
CACHE_WORDS = 1 << 20
CELLS = 1 << 20  #: bytes of words times languages that are scored together
SHORT = 8  #: pieces of more bytes are looked for only where one that begins with the same SHORT bytes may stand
RESCALE = 8  #: bytes between scalings


@dataclass
class Pieces:
    """Sorted hashes of the pieces; ids are places in `plain`, then in `start`, then the space, then none."""

    plain: np.ndarray
    start: np.ndarray
    lengths: tuple[int, ...]
    stems: np.ndarray  # hashes of the first SHORT bytes of longer pieces

    @property
    def space(self) -> int:
        return len(self.plain) + len(self.start)

    @property
    def none(self) -> int:
        return self.space + 1


def _hash(pieces: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(U64) + U64(1)
    end = np.cumsum([len(p) for p in pieces], dtype=np.int64)
    return np.unique(span(prefix(data), end - [len(p) for p in pieces], end)) if pieces else np.zeros(0, U64)


def pieces_of(vocabulary: bytes) -> Pieces:
    """The pieces of a vocabulary file of the byte-level kind."""
    plain, start = {bytes([b]) for b in range(256)}, set()
    for line in vocabulary.splitlines():
        t = base64.b64decode(line.split()[0])
        try:
            t = t.decode().lower().encode()
        except UnicodeDecodeError:
            pass
        body = t[1:] if t[:1] == b" " else t
        if re.fullmatch(rb"[a-z0-9\x80-\xff]+", body):
            (start if t[:1] == b" " else plain).add(body)
    every = plain | start
    return Pieces(_hash(sorted(plain)), _hash(sorted(start)), tuple(sorted({len(p) for p in every})), _hash(sorted({p[:SHORT] for p in every if len(p) > SHORT})))


def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of h are in a sorted table, and where there."""
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    hit = np.flatnonzero(table[at] == h)
    return hit, at[hit]


@dataclass
class Lattice:
    """The edges of all stretches of some words, sorted by where they end and then by stretch. Longer stretches come first."""

    size: np.ndarray  # bytes of each stretch
    word: np.ndarray  # of each stretch
    ptr: np.ndarray  # edges by end
    part: np.ndarray  # stretch of each edge
    m: np.ndarray  # bytes
    piece: np.ndarray
    begin: np.ndarray  # whether the word's space goes before the piece


def lattice(p: Pieces, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> Lattice:
    """The edges of the words [start, end) of a buffer."""
    n = end - start
    lo = np.cumsum(n) - n
    buf = buf[np.repeat(start - lo, n) + np.arange(n.sum())]
    sums = prefix(buf.astype(U64) + U64(1))
    left = np.repeat(lo + n, n) - np.arange(len(buf))
    some = np.flatnonzero(left > SHORT)
    stems = some[_find(p.stems, span(sums, some, some + SHORT))[0]]
    first = np.zeros(len(buf) + 1, bool)
    first[lo] = True
    edges = []
    for m in p.lengths:
        i = np.flatnonzero(left >= m) if m <= SHORT else stems[left[stems] >= m]
        if not len(i):
            continue
        h = span(sums, i, i + m)
        hit, at = _find(p.plain, h)
        edges.append((i[hit], np.full(len(hit), m), at, first[i[hit]]))
        i, h = i[first[i]], h[first[i]]
        hit, at = _find(p.start, h)
        edges.append((i[hit], np.full(len(hit), m), at + len(p.plain), np.zeros(len(hit), bool)))
    i, m, piece, begin = (np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 4
    crossed = np.cumsum(np.bincount(i + 1, minlength=len(buf) + 2) - np.bincount(i + m, minlength=len(buf) + 2))[: len(buf)]
    cut = first[: len(buf)] | (crossed == 0)
    at = np.flatnonzero(cut)
    size = np.diff(np.r_[at, len(buf)])
    by = np.argsort(-size, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    of = (np.cumsum(cut) - 1)[i] if len(i) else i
    stop, part = i - at[of] + m, rank[of]
    order = np.lexsort([part, stop])
    word = np.searchsorted(lo, at[by], "right") - 1
    return Lattice(size[by], word, np.searchsorted(stop[order], np.arange(int(size.max(initial=0)) + 2)), part[order], m[order], piece[order], begin[order])


def _runs(part: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, part[1:] != part[:-1]])


def word_scores(p: Pieces, prob: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[word, language]: logarithm of the sum over all segmentations."""
    out = np.zeros((len(start), len(prob)))
    if not out.size:
        return out
    table, space = np.ascontiguousarray(prob.T), prob[:, p.space]
    fill = np.cumsum(end - start) // max(1, CELLS // len(prob))
    cuts = np.flatnonzero(np.r_[True, fill[1:] != fill[:-1], True])
    for c, d in zip(cuts, cuts[1:]):
        x = lattice(p, buf, start[c:d], end[c:d])
        step = (1 << 22) // ((p.lengths[-1] + 1) * len(prob))
        for k in range(0, len(x.size), step):
            np.add.at(out[c:d], x.word[k : k + step], _forward(x, table, space, p.lengths[-1] + 1, k, min(k + step, len(x.size))))
    return out


def _forward(x: Lattice, table: np.ndarray, space: np.ndarray, ring: int, low: int, high: int) -> np.ndarray:
    """[stretch, language] for the stretches [low, high): each state is the sum over the segmentations up to a byte; `ring` of them are held."""
    a = np.zeros((ring, high - low, table.shape[1]))
    a[0] = 1
    logs, out = np.zeros(a.shape[1:]), np.zeros(a.shape[1:])
    alive = high - low
    for j in range(1, int(x.size[low]) + 1):
        still = int(np.searchsorted(-x.size[low:high], -j, "right"))
        e = slice(*(x.ptr[j : j + 2]))
        if low or high < len(x.size):
            e = slice(*(e.start + np.searchsorted(x.part[e], [low, high])))
        part = x.part[e] - low
        w = table[x.piece[e]]
        if j <= ring and (b := x.begin[e]).any():
            w[b] *= space
        now = a[j % ring]
        now[:still] = np.add.reduceat(a[(j - x.m[e]) % ring, part] * w, _runs(part))  # every byte is a piece, so each stretch has an edge
        if j % RESCALE == 0:
            top = now[:still].copy()
            a[:, :still] /= top
            logs[:still] += np.log(top)
        done = int(np.searchsorted(-x.size[low:high], -j - 1, "right"))
        out[done:still] = np.log(now[done:still]) + logs[done:still]
        alive = done
    return out


def fit(p: Pieces, column: pa.Array, labels: list[str], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """The languages and the probabilities of their pieces, by expectation-maximisation over all segmentations."""
    langs = sorted(set(labels))
    w, ptr, start, end = words(column)
    buf = text_bytes(column)[0]
    lang = np.array([langs.index(x) for x in labels], np.int64)[rows_of(ptr)]
    uniq, at, inv = np.unique(w, return_index=True, return_inverse=True)
    count = np.zeros((len(uniq), len(langs)))
    np.add.at(count, (inv, lang), 1.0)
    size = p.none + 1
    prob = np.full((len(langs), size), 1.0 / size)
    prob[:, p.none] = 0
    step = max(1, (1 << 15) // len(langs))
    chunks = [(lattice(p, buf, start[at[c : c + step]], end[at[c : c + step]]), c) for c in range(0, len(uniq), step)]
    for _ in range(rounds):
        got = np.full(prob.shape, SMOOTH)
        for x, c in chunks:
            low = int(np.searchsorted(-x.size, -FIT_BYTES, "left"))  # longer stretches come before
            if low < len(x.size):
                _expected(p, x, low, count[c + x.word], prob, got)
        got[:, p.none] = 0
        prob = got / got.sum(1, keepdims=True)
    return langs, prob


def _expected(p: Pieces, x: Lattice, low: int, count: np.ndarray, prob: np.ndarray, got: np.ndarray) -> None:
    """Add the expected counts of all pieces in the stretches from `low` on to got."""
    most = int(x.size[low])
    e = np.arange(x.ptr[1], x.ptr[most + 1])
    e = e[x.part[e] >= low]
    part, m, piece, begin = x.part[e] - low, x.m[e], x.piece[e], x.begin[e]
    stop = np.repeat(np.arange(most + 1), np.diff(x.ptr[: most + 2]))[e]
    size = x.size[low:]
    scale = 32.0  # for each byte, so that long stretches don't vanish
    w = prob.T[piece] * (scale ** m)[:, None]
    w[begin] *= prob[:, p.space]
    a = np.zeros((most + 1, len(size), len(prob)))
    a[0] = 1
    ptr = np.searchsorted(stop, np.arange(most + 2))
    for j in range(1, most + 1):
        s = slice(ptr[j], ptr[j + 1])
        new = _runs(part[s])
        a[j, part[s][new]] = np.add.reduceat(a[j - m[s], part[s]] * w[s], new)
    b = np.zeros_like(a)
    b[size, np.arange(len(size))] = 1
    begins = stop - m
    order = np.lexsort([part, -begins])
    at = np.searchsorted(-begins[order], -np.arange(most, -2, -1))
    for k, i in enumerate(range(most, -1, -1)):
        s = order[at[k] : at[k + 1]]
        if len(s):
            new = _runs(part[s])
            b[i, part[s][new]] += np.add.reduceat(b[stop[s], part[s]] * w[s], new)
    flow = a[begins, part] * b[stop, part] * w * (count[low:] / b[0])[part]
    for k in range(len(prob)):
        got[k] += np.bincount(piece, flow[:, k], prob.shape[1])
        got[k, p.space] += flow[begin, k].sum()


class Scorer:
    """Scores whole texts, keeping the words that it has scored."""

    def __init__(self, p: Pieces, langs: list[str], prob: np.ndarray):
        self.p, self.langs, self.prob = p, langs, prob
        self.known, self.scores = np.zeros(0, U64), np.zeros((0, len(langs)))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words of each text, sums of the words' scores by language)."""
        w, ptr, start, end = words(column)
        buf = text_bytes(column)[0]
        uniq, at, inv = np.unique(w, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, uniq)
        new = np.ones(len(uniq), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != uniq
        if new.any():
            fresh = word_scores(self.p, self.prob, buf, start[at[new]], end[at[new]])
            if len(self.known) > CACHE_WORDS:  # begin again with this batch's words
                keep = place[~new]
                self.known, self.scores = self.known[keep], self.scores[keep]
            both = np.concatenate([self.known, uniq[new]])
            order = np.argsort(both, kind="stable")
            self.known, self.scores = both[order], np.concatenate([self.scores, fresh])[order]
        of = self.scores[np.searchsorted(self.known, uniq)]
        row, n = rows_of(ptr), np.diff(ptr)
        return n, np.stack([np.bincount(row, of[inv, k], len(n)) for k in range(len(self.langs))], 1) if len(self.langs) else np.zeros((len(n), 0))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = TRAIN_TEXTS, vocabulary: str = VOCABULARY) -> tuple[Pieces, list[str], np.ndarray]:
    """Pieces, languages and probabilities from `texts` labelled rows of each language, chosen by a hash of their ids."""
    with open(vocabulary, "rb") as f:
        p = pieces_of(f.read())
    key, lang, turn = fresh(docs, "key", "lang", "turn")
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias(key), F.col(lang_col).alias(lang))
    nth = F.row_number().over(Window.partitionBy(lang).orderBy(F.xxhash64(key), key))
    chosen = known.withColumn(turn, nth).filter(F.col(turn) <= texts).select(key).distinct()
    rows = docs.join(F.broadcast(chosen), docs[f"`{id_col}`"] == F.col(key), "left_semi")  # bounded by `texts`
    table = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).orderBy("l", F.xxhash64("t")).toArrow()
    if not table.num_rows:
        return p, [], np.zeros((0, p.none + 1))
    return p, *fit(p, table["t"].combine_chunks(), table["l"].to_pylist())


def identified(docs: DataFrame, model: tuple[Pieces, list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, language, margin, probability): margin is the lead over the next language in nats a word."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, langs, prob = sent.value
        score = Scorer(p, langs, prob)
        names = np.array([*langs, "und"], object)
        for big in tidied(batches):
            for b in slices(big, "__text"):
                n, total = score(b.column(1))
                some = (n > 0) & bool(langs)
                padded = np.concatenate([total, np.full((len(n), 2), -np.inf)], 1)
                best = np.where(some, padded.argmax(1), len(langs))
                top = -np.sort(-padded, 1)[:, :2]
                with np.errstate(all="ignore"):
                    margin = np.where(np.isfinite(top[:, 1]), (top[:, 0] - top[:, 1]) / n, 0.0)
                    sure = 1 / np.exp(padded - top[:, :1]).sum(1)
                null = ~some
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(names[best].tolist(), pa.string()), pa.array(margin, mask=null), pa.array(sure, mask=null)], [id_col, "n_words", "language", "margin", "probability"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, language string, margin double, probability double")
