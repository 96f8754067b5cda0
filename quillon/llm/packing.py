"""Best-fit packing after a Martello-Toth dominance reduction.

Texts of more than CONTEXT tokens are cut: whole contexts stand alone and the remainder is packed like any other text. Packing looks only at how
many texts have each length, so the instance never exceeds CONTEXT numbers, whatever the corpus. The reduction fixes a set of texts
as a full sequence where no other set with its largest member could do better: a text with which nothing fits, a pair that fills
the sequence or of which no second partner could be added, the two cases with up to two partners. What is left is packed by
best fit, longest first, each text going where the least room remains. Sequences are then handed out to the texts of each
length in the order of their ids.

Cases: texts that are null or empty have no tokens and are in no sequence. Repeated rows are packed as often as they stand. Ties between texts
of a length go by id, then by part. Texts are counted whole. Other columns are never read; an empty table gives no sequences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import written
from quillon.llm.tokens import VOCABULARY, token_counts

CONTEXT = 2048
PARTS = 16  #: lists of texts of one length, numbered apart
Pattern = tuple[int, ...]


class _Lengths:
    """A multiset of lengths that finds its least and greatest members by bits."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v}
        self.mask = sum(1 << k for k in self.n)

    def change(self, length: int, by: int) -> None:
        left = self.n.get(length, 0) + by
        self.n[length] = left
        self.mask = self.mask | 1 << length if left else self.mask & ~(1 << length)

    def largest(self, most: int) -> int:
        """The largest length up to `most`, or 0."""
        return max(0, (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1) if most > 0 else 0

    def smallest(self, k: int, above: int = 0) -> list[int]:
        """The k smallest members above a length, with repetitions; fewer where there are no more."""
        out: list[int] = []
        mask = self.mask >> (above + 1) << (above + 1)
        while mask and len(out) < k:
            x = (mask & -mask).bit_length() - 1
            out += [x] * min(k - len(out), self.n[x])
            mask &= mask - 1
        return out


def _best_pair(rest: _Lengths, room: int) -> int:
    """The largest sum up to `room` of two members."""
    have = sorted(k for k, v in rest.n.items() if v and k <= room)
    best, j = 0, len(have) - 1
    for i, a in enumerate(have):
        while j >= 0 and a + have[j] > room:
            j -= 1
        if j < i:
            break
        best = max(best, a + have[j] if j > i or rest.n[a] > 1 else a + have[j - 1] if j > 0 and j - 1 >= i else 0)
    return best


def _dominant(rest: _Lengths, length: int, capacity: int) -> Pattern | None:
    """The partners with which a text of this length can be fixed, if that is provable; `rest` is without the text."""
    room = capacity - length
    low = rest.smallest(3)
    if not low or low[0] > room:
        return ()
    k = rest.largest(room)
    if k == room or len(low) < 2 or low[0] + low[1] > room:
        return (k,)
    if len(low) == 3 and sum(low) <= room:
        return None
    rest.change(k, -1)
    b = rest.largest(room - k)
    above = rest.smallest(2, b) if b else []
    rest.change(k, 1)
    if b:
        # partners that are both longer than b don't fit; any others are at most as long as k and b
        if k > b:
            above = sorted([*above, k])[:2]
        if len(above) < 2 or sum(above) > room:
            return (k, b)
    return (k,) if k >= _best_pair(rest, room) else None


def reduced(counts: dict[int, int], capacity: int) -> tuple[Counter[Pattern], dict[int, int]]:
    """Sequences that can be fixed without using more of them than is needed, and the lengths that are left."""
    rest, fixed = _Lengths(counts), Counter()
    changed = True
    while changed:
        changed = False
        for length in sorted((k for k, v in rest.n.items() if v), reverse=True):
            while rest.n[length]:
                rest.change(length, -1)
                partners = _dominant(rest, length, capacity)
                rest.change(length, 1)
                if partners is None:
                    break
                pattern = (length, *partners)
                times = min(rest.n[k] // v for k, v in Counter(pattern).items())
                fixed[tuple(sorted(pattern, reverse=True))] += times
                for k, v in Counter(pattern).items():
                    rest.change(k, -times * v)
                changed = True
    return fixed, {k: v for k, v in rest.n.items() if v}


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best fit, longest first, many sequences with the same room at a time."""
    open_: dict[int, list[tuple[Pattern, int]]] = {capacity: []}
    rooms = 0  # bits of the rooms that sequences have
    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        n = counts[length]
        while n:
            higher = rooms >> length << length
            room = (higher & -higher).bit_length() - 1 if higher else capacity
            pattern, have = open_[room].pop() if higher else ((), n)
            fit = room // length
            full = min(have, n // fit)
            used = full + (1 if full < have and n - full * fit else 0)
            if have > used and higher:
                open_[room].append((pattern, have - used))
            if higher and not open_[room]:
                rooms &= ~(1 << room)
            for bins, each in ((full, fit), (used - full, n - full * fit)):
                if bins:
                    left = room - each * length
                    open_.setdefault(left, []).append((pattern + (length,) * each, bins))
                    rooms |= 1 << left if left else 0
                    n -= bins * each
    out: Counter[Pattern] = Counter()
    for same in open_.values():
        for p, n in same:
            out[p] += n
    return out


def packed(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """How often each pattern of lengths is a sequence."""
    fixed, rest = reduced(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: Counter[Pattern]) -> dict[str, np.ndarray]:
    """For the texts of each length, by number: the sequences that they fill and where in these they begin."""
    at: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, n in sorted(patterns.items(), reverse=True):
        begin = 0
        for length in pattern:
            rows.append((length << 44 | at[length], sequence, begin))
            at[length] += n
            begin += length
        sequence += n
    rows.sort()
    key, seq, begin = np.array(rows, np.int64).reshape(-1, 3).T
    return {"key": key.copy(), "sequence": seq.copy(), "begin": begin.copy()}


def packed_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, n_tokens, sequence_id, start_token): where each part of each text stands."""
    spark = docs.sparkSession
    counts = token_counts(docs, id_col, text_col, vocabulary).filter("n_tokens > 0")
    parts = counts.select(F.col(id_col), "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {context}"))).alias("part"))
    size = F.least(F.lit(context).cast("long"), F.col("n_tokens") - F.col("part") * context).alias("n_tokens")
    items = written(parts.select(id_col, "part", size, F.pmod(F.xxhash64(id_col, "part"), F.lit(PARTS)).cast("int").alias("list")), "items")
    lists = sorted((r["n_tokens"], r["list"], r["count"]) for r in items.groupBy("n_tokens", "list").count().toLocalIterator())
    total: Counter[int] = Counter()
    first = np.zeros((context + 1) * PARTS, np.int64)
    for length, part, n in lists:
        first[length * PARTS + part] = total[length]
        total[length] += n
    sent = spark.sparkContext.broadcast((slots(packed(dict(total), context)), first))  # bounded by the context, not by the data
    numbered = items.withColumn("nth", F.row_number().over(Window.partitionBy("n_tokens", "list").orderBy(id_col, "part")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, before = sent.value
        for b in batches:
            n, part, nth = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3, 4))
            rank = before[n * PARTS + part] + nth - 1
            key = n << 44 | rank
            at = np.searchsorted(table["key"], key, "right") - 1
            seq = table["sequence"][at] + key - table["key"][at]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(seq), pa.array(table["begin"][at])], [id_col, "part", "n_tokens", "sequence_id", "start_token"])

    kind = dict(docs.dtypes)[id_col]
    return numbered.select(id_col, "part", "n_tokens", "list", "nth").mapInArrow(run, f"`{id_col}` {kind}, part long, n_tokens long, sequence_id long, start_token long")
