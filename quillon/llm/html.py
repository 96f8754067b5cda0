"""HTML extraction: a recurrent labeller of blocks.

A page is read into blocks, the texts between block-level tags, in order. A block is a vector: hashed parts of its tag path, hashed words and
a few sizes. A bidirectional LSTM in numpy reads all blocks of the page, and each block is labelled content or not from both directions'
states. The text of a page is that of its content blocks.

The network is trained here, on TRAIN_PAGES pages at most (a bound on the fit alone; chosen by a hash of their ids), by backpropagation through time.
Its targets are the pages' own semantics: what stands in main or article, outside navigation, asides, footers and advertisements, is content. In training the tag
path of a block is left out at random, so that the words and the other blocks must tell as well.

Cases: a null page has a null text and no blocks; an empty page, or one whose blocks are all labelled away, has an empty text. Broken markup is read on: tags
that are never closed end with the page, closing tags without an opening one are skipped. Pages are read whole; a page of any number of blocks is one sequence.
Repeated rows are read one by one. Without a page to train on every block is content. Other columns are never read; an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import small_batches, tidied

PATH_DIM = 24
WORD_DIM = 24
SIZES = 6
HIDDEN = 16
TRAIN_PAGES = 400
EPOCHS = 40
PATH_DROP = 0.3
CELLS = 1 << 15  #: blocks that run through the network together
_PART = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S | re.I)
_INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTENT = frozenset(("main", "article"))
_CHROME = frozenset("nav aside footer header menu form button select head title".split())
_NOISE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|cookie|promo|sidebar|share|social|nav|menu|footer|breadcrumbs?)(?:$|[\s_-])", re.I)
_NAME = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")

Block = tuple[tuple[str, ...], str]


def blocks(page: str) -> list[Block]:
    """(tag path, text) of each leaf of text, in order; a part of the path is a tag's name with its class and id."""
    out: list[Block] = []
    path: list[str] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = "".join(text)
            t = _SPACE.sub(" ", entities.unescape(joined) if "&" in joined else joined).strip()
            if t:
                out.append((tuple(path), t))
            text.clear()

    at = 0
    for m in _PART.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "a" and not m[2] and not text:
                text.append("")
            continue
        flush()
        if m[2]:
            for k in range(len(path) - 1, -1, -1):
                if path[k].partition(" ")[0] == name:
                    del path[k:]
                    break
        elif name not in _VOID and not m[4].rstrip().endswith("/"):
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and path and path[-1].partition(" ")[0] == name:
                path.pop()
            names = " ".join(x for t in _NAME.findall(m[4]) for x in t if x)
            path.append(f"{name} {names}" if names else name)
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def target(path: tuple[str, ...]) -> bool:
    """Whether the page's own markup says that a block is content."""
    names = [p.partition(" ") for p in path]
    return any(n in _CONTENT for n, _, _ in names) and not any(n in _CHROME or _NOISE.search(c) for n, _, c in names)


@lru_cache(1 << 14)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIM, np.float32)
    for k, part in enumerate(path[::-1]):
        for x in part.split():
            h = crc32(x.encode())
            v[h % PATH_DIM] += (1 if h >> 31 else -1) / (1 + 0.3 * k)
    return v


def vectors_of(pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page one row for each block."""
    flat = [b for p in pages for b in p]
    out = np.zeros((len(flat), PATH_DIM + WORD_DIM + SIZES), np.float32)
    if flat:
        ws = [t.lower().split() for _, t in flat]
        n = np.array([len(w) for w in ws])
        h = np.array([crc32(w.encode()) for x in ws for w in x], np.int64)
        of = np.repeat(np.arange(len(flat)), n)
        hashed = np.bincount(of * WORD_DIM + h % WORD_DIM, np.where(h >> 31, 1.0, -1.0), len(flat) * WORD_DIM).reshape(-1, WORD_DIM)
        count = np.maximum(n, 1)
        out[:, :PATH_DIM] = np.stack([_path_vector(p) for p, _ in flat])
        out[:, PATH_DIM : PATH_DIM + WORD_DIM] = hashed / np.sqrt(count)[:, None]
        sizes = np.array([(len(t), t.count(".") + t.count(","), t[-1:] in ".!?") for _, t in flat], float)
        length = np.array([len(p) for p in pages if p])
        total = np.repeat(length, length)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        out[:, -SIZES:] = np.stack([np.log1p(n), np.log1p(sizes[:, 0]), sizes[:, 1] / count, sizes[:, 2], place / total, np.log1p(total)], 1)
    return np.split(out, np.cumsum([len(p) for p in pages])[:-1]) if pages else []


@dataclass
class Labeller:
    """Two LSTMs (forward and backward: input, recurrent weights, bias of the gates i, f, o, g) and the output."""

    wf: np.ndarray
    uf: np.ndarray
    bf: np.ndarray
    wb: np.ndarray
    ub: np.ndarray
    bb: np.ndarray
    v: np.ndarray
    c: np.ndarray


def new_labeller(dim: int = PATH_DIM + WORD_DIM + SIZES, hidden: int = HIDDEN, seed: int = 0) -> Labeller:
    rng = np.random.default_rng(seed)
    gate = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]
    w = lambda a, b: rng.normal(0, a**-0.5, (a, b))
    return Labeller(w(dim, 4 * hidden), w(hidden, 4 * hidden), gate.copy(), w(dim, 4 * hidden), w(hidden, 4 * hidden), gate.copy(), w(2 * hidden, 1), np.zeros(1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States [time, page, hidden]; masked steps leave the state as it is. keep gets what the backward pass needs."""
    k = u.shape[0]
    z = x @ w + b
    h = np.zeros((x.shape[1], k), z.dtype)
    c = h.copy()
    out = np.empty((*x.shape[:2], k), z.dtype)
    for t in range(len(x)):
        a = z[t] + h @ u
        s = _sigmoid(a[:, : 3 * k])
        i, f, o, g = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :], np.tanh(a[:, 3 * k :])
        m = mask[t][:, None]
        new = f * c + i * g
        th = np.tanh(new)
        if keep is not None:
            keep.append((h, c, i, f, o, g, th, m))
        c = np.where(m, new, c)
        h = np.where(m, o * th, h)
        out[t] = h
    return out


def _lstm_back(x: np.ndarray, u: np.ndarray, keep: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the input weights, recurrent weights and bias."""
    dz = np.empty((*x.shape[:2], 4 * u.shape[0]))
    du, dh, dc = np.zeros_like(u), 0.0, 0.0
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, th, m = keep[t]
        dh = dh + d_out[t]
        dn = np.where(m, dc + dh * o * (1 - th * th), 0)
        a = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), np.where(m, dh * th * o * (1 - o), 0), dn * i * (1 - g * g)], 1)
        dz[t] = a
        du += h.T @ a
        dc = np.where(m, dn * f, dc)
        dh = np.where(m, a @ u.T, dh)
    return np.einsum("tpd,tpg->dg", x, dz), du, dz.sum((0, 1))


def scores(net: Labeller, x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """([time, page] logits, the states that gave them)."""
    f = _lstm(x, mask, net.wf, net.uf, net.bf, keep and keep[0])
    b = _lstm(x[::-1], mask[::-1], net.wb, net.ub, net.bb, keep and keep[1])[::-1]
    h = np.concatenate([f, b], 2)
    return (h @ net.v + net.c)[..., 0], h


def gradients(net: Labeller, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, Labeller]:
    """The mean loss of a batch and its gradient."""
    keep: tuple[list, list] = ([], [])
    s, h = scores(net, x, mask, keep)
    n = mask.sum()
    loss = float((np.logaddexp(0, np.where(y > 0.5, -s, s)) * mask).sum() / n)
    d = np.where(mask, _sigmoid(s) - y, 0)[..., None] / n
    dh, k = d @ net.v.T, net.uf.shape[0]
    f = _lstm_back(x, net.uf, keep[0], dh[..., :k])
    b = _lstm_back(x[::-1], net.ub, keep[1], dh[::-1, :, k:])
    return loss, Labeller(*f, *b, np.einsum("tph,tpo->ho", h, d), d.sum((0, 1)))


def _batches(pages: list[np.ndarray], cells: int) -> Iterator[list[int]]:
    """Pages of about equal length, so many that their cells fit."""
    group: list[int] = []
    for i in sorted(range(len(pages)), key=lambda i: len(pages[i])):
        if group and (len(group) + 1) * len(pages[i]) > cells:
            yield group
            group = []
        if len(pages[i]):
            group.append(i)
    if group:
        yield group


def _stacked(pages: list[np.ndarray], dtype: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), pages[0].shape[1]), dtype)
    mask = np.zeros(x.shape[:2], bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def fit(pages: list[list[Block]], epochs: int = EPOCHS, seed: int = 0) -> Labeller | None:
    """A labeller trained on pages that have a main part; None without any."""
    pages = [p for p in pages if any(target(path) for path, _ in p)]
    if not pages:
        return None
    rng, net = np.random.default_rng(seed), new_labeller(seed=seed)
    xs, ys = vectors_of(pages), [np.array([[target(path)] for path, _ in p], float) for p in pages]
    names = [f.name for f in fields(net)]
    state = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    step, groups = 0, list(_batches(xs, 600))
    for _ in range(epochs):
        for g in (groups[i] for i in rng.permutation(len(groups))):
            x, mask = _stacked([xs[i] for i in g])
            x[:, :, :PATH_DIM] *= rng.random((*x.shape[:2], 1)) >= PATH_DROP
            grad = gradients(net, x, mask, _stacked([ys[i] for i in g])[0][..., 0])[1]
            step += 1
            for k in names:
                m, v = state[k]
                d = np.clip(getattr(grad, k), -1, 1)
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                getattr(net, k)[...] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def labelled(net: Labeller | None, pages: list[list[Block]]) -> list[np.ndarray]:
    """Whether each block of each page is content."""
    if net is None:
        return [np.ones(len(p), bool) for p in pages]
    light = Labeller(*(getattr(net, f.name).astype(np.float32) for f in fields(net)))
    xs, out = vectors_of(pages), [np.zeros(len(p), bool) for p in pages]
    for g in _batches(xs, CELLS):
        x, mask = _stacked([xs[i] for i in g], np.float32)
        s = scores(light, x, mask)[0]
        for k, i in enumerate(g):
            out[i] = s[: len(xs[i]), k] > 0
    return out


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = TRAIN_PAGES) -> Labeller | None:
    """A labeller fitted on `most` pages."""
    chosen = pages.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(most)
    rows = pages.join(F.broadcast(chosen), F.col(id_col) == F.col("__id"), "left_semi")  # bounded by `most`
    got = rows.filter(F.col(html_col).isNotNull()).select(F.col(html_col).alias("h")).orderBy(F.xxhash64("h"), "h").toArrow()
    return fit([blocks(p) for p in got["h"].to_pylist()])


def extracted(pages: DataFrame, net: Labeller | None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, n_blocks, n_content, text): the content blocks of each page, a line for each."""
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(net)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in tidied(batches):
            size = pc.fill_null(pc.binary_length(big.column(1)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(size, dtype=np.int64) // (4 << 20)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), big.num_rows]
            for a, e in zip(cuts, cuts[1:]):
                b = big.slice(a, e - a)
                raw = b.column(1).to_pylist()
                found = [blocks(p) if p else [] for p in raw]
                content = labelled(sent.value, found)
                texts = [None if p is None else "\n".join(t for (_, t), k in zip(f, c) if k) for p, f, c in zip(raw, found, content)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(f) for f in found], pa.int32()), pa.array([int(c.sum()) for c in content], pa.int32()), pa.array(texts, pa.string())], [id_col, "n_blocks", "n_content", "text"])

    kind = dict(pages.dtypes)[id_col]
    return pages.select(id_col, F.col(html_col).alias("__html")).mapInArrow(run, f"`{id_col}` {kind}, n_blocks int, n_content int, text string")
