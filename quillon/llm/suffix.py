"""Suffix sorting with a difference cover, one bucket of suffixes at a time.

D is a difference cover modulo V: for any two positions there is a shift below V that takes both to positions whose residue is in D. The
suffixes at those positions are ranked first. Any two suffixes then compare by their first symbols and, on a tie, by two ranks, so a
bucket is sorted on its own, in memory that its size bounds, however long its ties are.
"""

from __future__ import annotations

import numpy as np

V = 31
COVER = (1, 5, 11, 24, 25, 27)
HEAD = 32  #: symbols that are compared before the ranks; V or more
BUCKET = 1 << 18


def shift_table(v: int = V, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """[i, j]: the least shift that takes both residues into the cover."""
    inside = np.zeros(v, bool)
    inside[list(cover)] = True
    s = np.arange(v)
    both = inside[(s[:, None, None] + s) % v] & inside[(s[None, :, None] + s) % v]
    if not both.any(2).all():
        raise ValueError("not a difference cover")
    return both.argmax(2)


SHIFT = shift_table()


def _dense(text: np.ndarray) -> tuple[np.ndarray, int]:
    """The text in symbols 1, 2, ... of the same order, and the bits that a symbol has."""
    ranks = np.unique(text, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    return ranks, int(ranks.max(initial=np.uint64(1))).bit_length()


def _heads(padded: np.ndarray, at: np.ndarray, bits: int) -> list[np.ndarray]:
    """Keys that order suffixes by their first HEAD symbols, the first key being the weightiest."""
    each = 64 // bits
    out = []
    for i in range(0, HEAD, each):
        key = np.zeros(len(at), np.uint64)
        for k in range(i, min(i + each, HEAD)):
            key = (key << np.uint64(bits)) | padded[at + k]
        out.append(key)
    return out


def _new(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """For each place of the order, whether it differs from the one before."""
    out = np.zeros(len(order), bool)
    out[:1] = True
    for k in keys:
        s = k[order]
        out[1:] |= s[1:] != s[:-1]
    return out


def cover_ranks(padded: np.ndarray, bits: int) -> np.ndarray:
    """The rank of the suffix at each position whose residue is in the cover, 0 elsewhere."""
    n = len(padded) - HEAD
    chosen = np.zeros(V, bool)
    chosen[list(COVER)] = True
    at = np.flatnonzero(chosen[np.arange(n) % V])
    rank = np.zeros(n + 2 * V, np.int64)
    keys = _heads(padded, at, bits)
    step = V  # the heads are longer, so this much is surely sorted
    while True:
        order = np.lexsort(keys[::-1])
        new = _new(keys, order)
        rank[at[order]] = np.cumsum(new)
        if new.all() or step > n:
            return rank
        keys = [rank[at], rank[np.minimum(at + step, n + V)]]
        step *= 2


def sorted_suffixes(text: np.ndarray, wanted: np.ndarray, bucket: int = BUCKET) -> np.ndarray:
    """The positions of `wanted` in the order of their suffixes.

    The text is padded with a symbol below all others. wanted holds distinct positions.
    """
    if not len(wanted):
        return wanted
    dense, bits = _dense(text)
    padded = np.concatenate([dense, np.zeros(HEAD + 2 * V, np.uint64)])
    rank = cover_ranks(padded, bits)
    first = dense[wanted]
    by_first = np.argsort(first, kind="stable")
    fill = np.cumsum(np.bincount(first.astype(np.int64)))
    out, done = [], 0
    while done < len(wanted):  # buckets of whole first symbols, of `bucket` suffixes or one symbol's
        s = int(np.searchsorted(fill, done + bucket, "right"))
        end = int(fill[s - 1]) if s and fill[s - 1] > done else int(fill[np.searchsorted(fill, done, "right")])
        out.append(_sorted_bucket(padded, rank, wanted[by_first[done:end]], bits))
        done = end
    return np.concatenate(out)


def _sorted_bucket(padded: np.ndarray, rank: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    keys = _heads(padded, at, bits)
    order = np.lexsort(keys[::-1])
    new = _new(keys, order)
    at = at[order]
    part = np.cumsum(new) - 1
    rng = np.random.default_rng(0)
    while True:  # quicksort of all ties at once, by ranks of the cover
        size = np.bincount(part)
        live = np.flatnonzero(size[part] > 1)
        if not len(live):
            return at
        ids, begin, count = np.unique(part[live], return_index=True, return_counts=True)
        pivot = np.repeat(at[live[begin + rng.integers(0, count)]], count)
        mine = at[live]
        shift = SHIFT[mine % V, pivot % V]
        side = np.sign(rank[mine + shift] - rank[pivot + shift])
        turn = np.lexsort([side, part[live]])
        at[live] = mine[turn]
        new = np.zeros(len(at), bool)
        new[:1] = True
        new[1:] = part[1:] != part[:-1]
        s, p = side[turn], part[live]
        new[live[1:]] |= (s[1:] != s[:-1]) & (p[1:] == p[:-1])
        part = np.cumsum(new) - 1


def same_start(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of a sorted list, whether it shares its first `length` symbols with the one before it; suffixes must be that long."""
    out = np.zeros(len(order), bool)
    left = np.arange(1, len(order))
    for k in range(length):
        left = left[text[order[left] + k] == text[order[left - 1] + k]]
        if not len(left):
            break
    out[left] = True
    return out
