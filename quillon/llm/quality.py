"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network with calibrated probabilities.

Every token (a word in its own case, or a run of punctuation) has a sparse index vector of +1 and -1 that its hash gives. A token's context vector is the
sum of the index vectors of its neighbours, up to REACH places away, over all documents. Tokens are counted over all documents by their 64-bit hashes; each with a share of SHARE or more of
all tokens has a context vector of its own, so the table grows with the corpus' vocabulary up to 1 / SHARE rows, a bound that lets it be sent to the executors. Rarer tokens, whose few
neighbours tell little, have none. Every token, however rare, has a dense vector of its own by its hash, which it shares with no other. A document is the weighted mean of its
tokens' context vectors and of their own vectors, where frequent tokens weigh less, and for each label the mean of the own vectors of its distinct tokens by their evidence: how much more often
labelled documents with the label have a token than those without it. (One word in a hundred may tell a fault; in the plain mean it is lost: with that alone 45 to 63 of 100 toxic documents of the
synthetic data were found, with both some 90.) The network has one hidden layer and an output for each label. It is fitted on MAX_LABELLED labelled documents at
most (a bound on the fit alone); a part held out from the fit sets a temperature for each output, so the probabilities are calibrated.

A document is kept where its quality is likelier than not and each fault (any label but the first) is not.

Cases: texts that are null or without tokens have null probabilities and aren't kept. Without labelled texts all probabilities are null and texts
with tokens are kept. Several labels of one document count as their largest; null labels aren't used. Repeated rows are scored one by one. Texts are
read whole. Other columns are never read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import TOKENS, U64, discard, mix, rows_of, slices, small_batches, tidied, words, written

DIM = 64
SHARE = 2e-6  #: of all tokens; a token below it has no context vector
REACH = 2
NONZERO = 4
WEIGHT = 1e-3  #: a token with this share of all tokens has half the weight of a rare one
MAX_LABELLED = 20_000
SURE = 2.5  #: standard errors that a token's evidence must exceed
HIDDEN = 32
EPOCHS = 30
HELD_OUT = 0.2
LABELS = ("quality", "toxic")
_CHUNK = 1 << 15


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed tokens and the first of each row."""
    w, ptr, _, _ = words(column, TOKENS, lower=False)
    return w, ptr


def index_entries(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each token's index vector."""
    k = np.arange(NONZERO).astype(U64)
    place = (w[:, None] >> (k * U64(6))) & U64(DIM - 1)
    sign = ((w[:, None] >> (U64(40) + k)) & U64(1)).astype(np.int64) * 2 - 1
    return place.astype(np.int64), sign


def own_vectors(w: np.ndarray) -> np.ndarray:
    """[token, DIM]: +1 or -1 by the bits of each token's hash."""
    bits = np.unpackbits(mix(w ^ U64(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def find(keys: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The place of each token in sorted keys; len(keys) where it isn't there."""
    if not len(keys):
        return np.zeros(len(w), np.int64)
    at = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
    return np.where(keys[at] == w, at, len(keys))


def context_sums(w: np.ndarray, ptr: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """[key, DIM]: sums of the neighbours' index vectors over rows of tokens."""
    row, b = rows_of(ptr), find(keys, w)
    place, sign = index_entries(w)
    cells, signs = [], []
    for o in range(1, REACH + 1):
        i = np.flatnonzero(row[:-o] == row[o:]) if len(w) > o else np.zeros(0, np.int64)
        for me, other in ((i, i + o), (i + o, i)):
            some = b[me] < len(keys)
            me, other = me[some], other[some]
            cells.append((b[me][:, None] * DIM + place[other]).ravel())
            signs.append(sign[other].ravel())
    return np.bincount(np.concatenate(cells), np.concatenate(signs), len(keys) * DIM).reshape(len(keys), DIM)


@dataclass
class Vectors:
    keys: np.ndarray  # sorted hashes of the tokens with a context vector
    table: np.ndarray  # [key, DIM + 1]: the weighted context vector and the weight


def token_counts_of(docs: DataFrame, text_col: str, share: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Over all documents: the sorted hashes of the tokens with a share of `share` or more, their counts, and the count of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, inv = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(inv, np.concatenate([n for _, n in held]), len(key)).astype(np.int64)

        for big in tidied(batches):
            for b in slices(big, "text"):
                held.append(np.unique(tokens(b.column(0))[0], return_counts=True))
                many += len(held[-1][0])
            if many > 1 << 20:  # counts of a task's tokens are merged as they grow, and given out before they are many
                held = [merged()]
                many = len(held[0][0])
                if many > 1 << 19:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["key", "n"])
                    held, many = [], 0
        if held:
            key, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    each = written(docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "tokens")
    total = each.agg(F.sum("n")).first()[0] or 0
    t = each.filter(F.col("n") >= share * total).toArrow()  # 1 / share rows at most
    discard(each)
    key = t["key"].to_numpy().view(U64)
    order = np.argsort(key)
    return key[order], t["n"].to_numpy()[order], int(total)


def word_vectors(docs: DataFrame, text_col: str = "text", share: float = SHARE) -> Vectors:
    """The context vectors of the corpus."""
    small_batches(docs.sparkSession)
    keys, count, total = token_counts_of(docs, text_col, share)
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = sent.value
        sums = np.zeros((len(have), DIM), np.int32)
        for big in tidied(batches):
            for b in slices(big, "text"):
                w, ptr = tokens(b.column(0))
                if len(w) and len(have):
                    sums += context_sums(w, ptr, have).astype(np.int32)
        at = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(sums[at, k]) for k in range(DIM))], ["at", *names])

    names = [f"d{k}" for k in range(DIM)]
    parts = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, ", ".join(f"{c} int" for c in ("at", *names)))
    t = parts.groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).toArrow()  # a row for each key
    sums = np.zeros((len(keys), DIM))
    if t.num_rows:
        sums[t["at"].to_numpy()] = np.stack([t[c].to_numpy() for c in names], 1)
    return Vectors(keys, weighted(sums, count, total))


def weighted(sums: np.ndarray, n: np.ndarray, total: int) -> np.ndarray:
    """[key, DIM + 1]: context vectors of length one about their mean, times the weight, and the weight."""
    mean = sums / np.maximum(n, 1)[:, None]
    mean = mean - (n[:, None] * mean).sum(0) / max(1, n.sum())
    unit = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
    weight = WEIGHT / (WEIGHT + n / max(1, total))
    return np.concatenate([unit * weight[:, None], weight[:, None]], 1).astype(np.float32)


def pooled(w: np.ndarray, ptr: np.ndarray, vectors: Vectors) -> np.ndarray:
    """One row of features for each row of tokens: the two means, their lengths and the logarithm of the count."""
    row = rows_of(ptr)
    table = np.concatenate([vectors.table, np.r_[np.zeros(DIM), 1.0][None].astype(np.float32)])  # the last row is of the tokens without a context vector
    sums = np.zeros((len(ptr) - 1, 2 * DIM + 1))
    for c in range(0, len(w), _CHUNK):
        r, x = row[c : c + _CHUNK], w[c : c + _CHUNK]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        uniq, inv = np.unique(x, return_inverse=True)
        known = table[find(vectors.keys, uniq)]
        own = own_vectors(uniq) * (known[:, -1:] / np.sqrt(DIM))
        sums[r[first]] += np.add.reduceat(np.concatenate([known[:, :-1], own, known[:, -1:]], 1)[inv], first, axis=0)
    means = sums[:, :-1] / np.maximum(sums[:, -1:], 1e-9)
    lengths = [np.linalg.norm(means[:, k : k + DIM], axis=1, keepdims=True) for k in (0, DIM)]
    return np.concatenate([means, *lengths, np.log1p(np.diff(ptr))[:, None]], 1)


def token_sets(w: np.ndarray, ptr: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places in keys of each row's tokens (len(keys) for all the rest), and where each row's begin."""
    cell = np.unique(rows_of(ptr) * (len(keys) + 1) + find(keys, w))
    return cell % (len(keys) + 1), np.searchsorted(cell, np.arange(len(ptr)) * (len(keys) + 1))


def evidence(at: np.ndarray, ptr: np.ndarray, y: np.ndarray, n_keys: int) -> np.ndarray:
    """[key, label]: how surely and strongly a token tells each label, from the shares of the labelled documents with and without the label that have it: the
    logarithm of their ratio, less SURE standard errors towards 0. The last row, of the tokens without a context vector, is 0."""
    out = np.zeros((n_keys + 1, y.shape[1]))
    row = rows_of(ptr)
    for k in range(y.shape[1]):
        with_, without = (np.bincount(at[(y[:, k] == v)[row]], minlength=n_keys + 1) + 0.5 for v in (1, 0))
        ratio = np.log(with_ / ((y[:, k] == 1).sum() + 1)) - np.log(without / ((y[:, k] == 0).sum() + 1))
        out[:, k] = np.sign(ratio) * np.maximum(0, np.abs(ratio) - SURE * np.sqrt(1 / with_ + 1 / without))
    out[-1] = 0
    return out


def pooled_by_evidence(at: np.ndarray, ptr: np.ndarray, proof: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each label: the mean of the rows' own vectors by the tokens' evidence, its sums for and against, and its extremes."""
    out, a = np.zeros((len(ptr) - 1, proof.shape[1] * (DIM + 4))), 0
    while a < len(out):  # a few rows at a time, as each token takes a vector
        b = max(a + 1, int(np.searchsorted(ptr, ptr[a] + _CHUNK, "right")) - 1)
        out[a:b] = _pooled_by_evidence(at[ptr[a] : ptr[b]], ptr[a : b + 1] - ptr[a], proof, keys)
        a = b
    return out


def _pooled_by_evidence(at: np.ndarray, ptr: np.ndarray, proof: np.ndarray, keys: np.ndarray) -> np.ndarray:
    n, out = len(ptr) - 1, []
    row = rows_of(ptr)
    some = np.flatnonzero(proof[at].any(1))
    at, row = at[some], row[some]
    own = own_vectors(keys[at]) if len(at) else np.zeros((0, DIM), np.float32)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    for k in range(proof.shape[1]):
        e = proof[at, k]
        x = np.zeros((n, DIM + 4))
        if len(first):
            x[row[first], :DIM] = np.add.reduceat(own * e[:, None], first, axis=0)
            for c, (f, v) in enumerate(((np.add, np.maximum(e, 0)), (np.add, np.maximum(-e, 0)), (np.maximum, e), (np.minimum, e))):
                x[row[first], DIM + c] = f.reduceat(v, first)
        x[:, :DIM] /= 1 + x[:, DIM : DIM + 2].sum(1, keepdims=True)
        x[:, DIM : DIM + 2] = np.log1p(x[:, DIM : DIM + 2])
        out.append(x)
    return np.concatenate(out, 1)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, a column for each label."""
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 0) -> Network:
    """A network for labels of 0, 1 or NaN (unknown), one column for each."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held = order[: int(len(x) * HELD_OUT)]
    train = order[len(held) :]
    mean, scale = x[train].mean(0), x[train].std(0) + 1e-2
    net = Network(mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, y.shape[1])), np.zeros(y.shape[1]), np.ones(y.shape[1]))
    z = (x - mean) / scale
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (net.w1, net.b1, net.w2, net.b2)]
    step, batch = 0, 128
    for _ in range(epochs if len(train) else 0):
        rng.shuffle(train)
        for c in range(0, len(train), batch):
            at = train[c : c + batch]
            h = np.tanh(z[at] @ net.w1 + net.b1)
            d = _sigmoid(h @ net.w2 + net.b2) - y[at]
            d = np.where(np.isnan(d), 0, d) / len(at)
            back = d @ net.w2.T * (1 - h * h)
            step += 1
            for p, g, (m, v) in zip((net.w1, net.b1, net.w2, net.b2), (z[at].T @ back + 1e-3 * net.w1, back.sum(0), h.T @ d + 1e-3 * net.w2, d.sum(0)), state):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if len(held):
        s, grid = net.logits(x[held]), np.geomspace(0.25, 8, 61)
        for k in range(y.shape[1]):
            ok = ~np.isnan(y[held, k])
            loss = [np.mean(np.logaddexp(0, np.where(y[held, k][ok] > 0.5, -1, 1) * s[ok, k] / t)) for t in grid] if ok.any() else [0.0]
            net.temperature[k] = grid[int(np.argmin(loss))] if ok.any() else 1.0
    return net


def fitted(x: np.ndarray, y: np.ndarray, at: np.ndarray, ptr: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, Network]:
    """The evidence of all labelled documents, and a network for whose fit each half of them is pooled by the other half's evidence."""
    half = np.random.default_rng(1).random(len(x)) < 0.5
    more = None
    for mine in (half, ~half):
        proof = evidence(at, ptr, np.where(mine[:, None], np.nan, y), len(keys))
        got = pooled_by_evidence(at, ptr, proof, keys)
        more = got if more is None else np.where(mine[:, None], got, more)
    return evidence(at, ptr, y, len(keys)).astype(np.float32), fit(np.concatenate([x, more], 1), y)


@dataclass
class Model:
    vectors: Vectors
    proof: np.ndarray | None
    net: Network | None


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_cols: tuple[str, ...] = LABELS, most: int = MAX_LABELLED, share: float = SHARE) -> Model:
    """The word vectors of all documents, and evidence and a network fitted on `most` labelled ones, chosen by a hash of their ids."""
    vectors = word_vectors(docs, text_col, share)
    names = [f"y{k}" for k in range(len(label_cols))]
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("known")).agg(*(F.max(c).cast("double").alias(y) for c, y in zip(label_cols, names)))
    chosen = known.orderBy(F.xxhash64("known"), "known").limit(most)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)  # 1 / share rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in tidied(batches):
            for b in slices(big, "text"):
                w, ptr = tokens(b.column(1))
                x = pooled(w, ptr, sent.value)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                at, ends = token_sets(w, ptr, sent.value.keys)
                sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), flat, sets, *b.columns[2:]], ["id", "x", "sets", *names])

    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc") == F.col("known")).filter("length(text) > 0")  # bounded by `most`
    kind = dict(docs.dtypes)[id_col]
    got = rows.select("doc", "text", *names).mapInArrow(run, f"id {kind}, x array<double>, sets array<int>, {', '.join(f'{y} double' for y in names)}").toArrow()
    if not got.num_rows:
        return Model(vectors, None, None)
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    y = np.stack([np.array(got[c].to_pylist(), float) for c in names], 1)
    by = np.lexsort(np.concatenate([x.T[:3], [np.unique(got["id"].to_pylist(), return_inverse=True)[1]]]))  # the fit doesn't depend on the order of partitions
    sets = got["sets"].combine_chunks()
    first, size = sets.offsets.to_numpy()[:-1][by], np.diff(sets.offsets.to_numpy())[by]
    ptr = np.r_[0, np.cumsum(size, dtype=np.int64)]
    at = sets.values.to_numpy()[np.repeat(first - ptr[:-1], size) + np.arange(ptr[-1])].astype(np.int64)
    del got, sets
    return Model(vectors, *fitted(x[by], y[by], at, ptr, vectors.keys))


def classified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", label_cols: tuple[str, ...] = LABELS) -> DataFrame:
    """(doc_id, p_<label> for each label, keep): keep where the first label is likelier than not and no other one is."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 1 / share rows at most
    names = [f"p_{c}" for c in label_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, proof, net = sent.value.vectors, sent.value.proof, sent.value.net
        for big in tidied(batches):
            for b in slices(big, "text"):
                w, ptr = tokens(b.column(1))
                some = np.diff(ptr) > 0
                p = net(np.concatenate([pooled(w, ptr, vectors), pooled_by_evidence(*token_sets(w, ptr, vectors.keys), proof, vectors.keys)], 1)) if net else np.full((len(some), len(names)), np.nan)
                mask = ~some if net else np.ones(len(some), bool)
                keep = some & (p[:, 0] >= 0.5) & (p[:, 1:] < 0.5).all(1) if net else some
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k], mask=mask) for k in range(len(names))), pa.array(keep)], [id_col, *names, "keep"])

    kind = dict(docs.dtypes)[id_col]
    fields = ", ".join(f"{c} double" for c in names)
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {fields}, keep boolean")
