from __future__ import annotations

import numpy as np
import pytest

from quillon.llm.suffix import same_start, shift_table, sorted_suffixes


def test_cover_has_every_difference():
    assert shift_table().max() < 31
    with pytest.raises(ValueError):
        shift_table(31, (1, 2, 3))


@pytest.mark.parametrize("n,symbols,bucket", [(1, 1, 4), (50, 1, 8), (400, 2, 16), (1500, 3, 100), (3000, 900, 64), (700, 1, 1 << 18)])
def test_order_against_naive(n, symbols, bucket):
    rng = np.random.default_rng(n)
    t = rng.integers(0, symbols, n).astype(np.uint32) * np.uint32(77_777)
    if n > 300:
        t[200:290] = t[20:110]  # ties longer than the heads
        t[n - 95 :] = t[10:105]
    naive = sorted(range(n), key=lambda i: t[i:].tolist())
    wanted = rng.permutation(n)
    assert sorted_suffixes(t, wanted, bucket).tolist() == naive
    some = np.sort(rng.choice(n, n // 2, replace=False))
    assert sorted_suffixes(t, some, bucket).tolist() == [i for i in naive if i in set(some.tolist())]


def test_same_start():
    t = np.array([1, 2, 3, 4, 1, 2, 3, 5, 9, 9, 9, 9])
    order = sorted_suffixes(t, np.arange(9))
    same = same_start(t, order, 3)
    assert [(int(a), int(b)) for a, b, s in zip(order, order[1:], same[1:]) if s] == [(0, 4)]
    assert len(sorted_suffixes(t, np.arange(0))) == 0
