from __future__ import annotations

import random
from collections import Counter

import pytest

from quillon.llm.packing import best_fit, packed, packed_sequences, reduced
from quillon.llm.tokens import token_counts

from .conftest import DATA


def fewest(items: list[int], capacity: int) -> int:
    """The least number of sequences, by trying all ways."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= items[i]:
                at = rooms.index(room)
                go(i + 1, [*rooms[:at], room - items[i], *rooms[at + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def plain_best_fit(items: list[int], capacity: int) -> int:
    rooms: list[int] = []
    for x in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(300))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 50])
    items = [rng.randint(rng.choice([1, capacity // 5, capacity // 4 + 1]), capacity) for _ in range(rng.randint(1, 11))]
    fixed, rest = reduced(Counter(items), capacity)
    used = Counter(x for p, n in fixed.items() for x in p for _ in range(n))
    assert used + Counter(rest) == Counter(items)
    assert all(sum(p) <= capacity for p in fixed)
    left = [k for k, v in rest.items() for _ in range(v)]
    assert sum(fixed.values()) + fewest(left, capacity) == fewest(items, capacity)


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_and_whole(seed):
    rng = random.Random(seed)
    items = [min(64, int(rng.paretovariate(1)) + rng.randint(0, 20) + 1) for _ in range(400)]
    got = best_fit(Counter(items), 64)
    assert sum(got.values()) == plain_best_fit(items, 64)
    both = packed(Counter(items), 64)
    for p in (got, both):
        assert Counter({k: v for k, v in sum((Counter({x: n * c for x, c in Counter(q).items()}) for q, n in p.items()), Counter()).items()}) == Counter(items)
        assert all(0 < sum(q) <= 64 for q in p)
    assert sum(both.values()) <= plain_best_fit(items, 64)


def check(rows, counts: dict[int, int], context: int) -> None:
    parts: dict[int, list] = {}
    bins: dict[int, list] = {}
    for r in rows:
        parts.setdefault(r[0], []).append((r.part, r.n_tokens))
        bins.setdefault(r.sequence_id, []).append((r.start_token, r.n_tokens))
    assert {d: sum(n for _, n in x) for d, x in parts.items()} == {d: n for d, n in counts.items() if n}
    assert all(sorted(k for k, _ in x) == list(range(len(x))) for x in parts.values())
    for x in bins.values():
        end = 0
        for start, n in sorted(x):
            assert start == end
            end += n
        assert end <= context
    assert sorted(bins) == list(range(len(bins)))


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    rows = packed_sequences(docs).collect()
    check(rows, counts, 2048)
    used = len({r.sequence_id for r in rows})
    items = [min(2048, n - i) for n in counts.values() for i in range(0, n, 2048)]
    assert -(-sum(items) // 2048) <= used <= plain_best_fit(items, 2048)


def test_edges(spark, edge_docs):
    docs = edge_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check(packed_sequences(docs).collect(), {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}, 2048)
    assert len(packed_sequences(edge_docs).filter("doc_id = 5 OR doc_id IS NULL").collect()) == 3
    assert packed_sequences(edge_docs.limit(0)).count() == 0
