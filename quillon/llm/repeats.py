"""Suffix-array dedup: passages of LENGTH words or more that stand in several places.

A window is LENGTH words in a row. The first place of a window, by document id and then position, stays; every other place of it is a
repeat, and a word goes when a repeated window covers it. Words are those of shared.py, so case and punctuation don't matter.

Windows that are equal have the same least KGRAM-word hash at the same place, so blocks (runs of windows with the same least hash, their
anchor) bring equal windows together without moving the text: 1. blocks are found, as hashes; 2. those whose anchor stands only once go;
3. blocks of the same words count as one, at their first place; 4. where an anchor has different blocks, a suffix array of their
words (suffix.py: difference-cover blockwise sorting, one bucket of suffixes at a time) finds the windows that they share; 5. each place
of a block gets what was found for its words. The blocks of a frequent anchor are spread over suffix arrays of about GROUP_WORDS words, and each array's distinct windows then
meet by their hashes, so no task holds more than an array, however many documents share a passage. Counts and first places are aggregated before they are shuffled. The result is
exact, up to collisions of 64-bit hashes.

Cases: null, empty and shorter texts have no windows. Rows without an id are not searched and stay untouched. Ids are whole numbers. Rows with the same id and the same words are one
document; of rows with the same id and other words each has its own places, and loses only what it repeats itself. Texts are read whole. Other columns pass through, whatever their
names; an empty table gives no repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import U64, discard, prefix, rows_of, slices, small_batches, span, text_bytes, tidied, with_ids, words, written
from quillon.llm.suffix import same_start, sorted_suffixes

LENGTH = 50
KGRAM = 16
CHUNK = 1 << 20  #: windows looked at together
GROUP_WORDS = 1 << 20  #: words of blocks that one suffix array holds, more or less


def blocks(w: np.ndarray, ptr: np.ndarray, length: int = LENGTH, kgram: int = KGRAM) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor, content) of the blocks in rows of words; windows are counted from the first word of all."""
    found, width = [], length - kgram + 1
    of = rows_of(ptr)
    for c in range(0, max(0, len(w) - length + 1), CHUNK):
        part = w[c : c + CHUNK + length - 1]
        n = len(part) - length + 1
        sums = prefix(part)
        i = np.arange(len(part) - kgram + 1)
        gram = span(sums, i, i + kgram)
        least = ((gram >> U64(24)) << U64(24)) | i.astype(U64)
        have = 1
        while have * 2 <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: have - width], least[width - have :])
        at = (least[:n] & U64((1 << 24) - 1)).astype(np.int64)
        row = of[c : c + n]
        ok = row == of[c + length - 1 : c + length - 1 + n]
        new = ok.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1] | (row[1:] != row[:-1])
        start = np.flatnonzero(new)
        if not len(start):
            continue
        run = np.cumsum(new) - 1
        size = np.bincount(run[ok], minlength=len(start))
        found.append((row[start], start + c, size, gram[at[start]], span(sums, start, start + size + length - 1)))
    if not found:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(U64), e.astype(U64)
    return tuple(np.concatenate(x) for x in zip(*found))


def versions(w: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A number for the words of each row, which tells rows with the same id apart."""
    return (span(prefix(w), ptr[:-1], ptr[1:]) >> U64(32)).astype(np.uint32).view(np.int32)


def _blocks(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in tidied(batches):
            for b in slices(big, "text"):
                w, ptr, _, _ = words(b.column(1))
                row, start, size, anchor, content = blocks(w, ptr, length)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array(versions(w, ptr)[row]), pa.array((start - ptr[row]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                    ["doc", "v", "start", "size", "anchor", "content"],
                )

    return docs.mapInArrow(run, "doc long, v int, start int, size int, anchor long, content long")


_CUT = "doc long, v int, start int, size int, anchor long, content long, cuts int, symbols array<int>"


def _block_words(texts: DataFrame, length: int) -> DataFrame:
    """Of rows (doc, text, wanted: the blocks of it), each block with its words as 32-bit symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in tidied(batches):
            for b in slices(big, "text"):
                w, ptr, _, _ = words(b.column(1))
                sym = (w >> U64(32)).astype(np.uint32)
                want = b.column(2)
                row = pc.list_parent_indices(want).to_numpy()
                flat = pc.list_flatten(want)
                v, start, size = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("v", "start", "size"))
                count = size + length - 1
                a = ptr[row] + start
                ok = v == versions(w, ptr)[row]  # rows with the same id may have other texts
                row, a, count, flat = row[ok], a[ok], count[ok], flat.filter(pa.array(ok))
                ends = np.cumsum(count)
                at = np.repeat(a - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
                offsets = pa.array(np.r_[0, ends].astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(sym[at].view(np.int32)))
                names = ("v", "start", "size", "anchor", "content", "cuts")
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *(flat.field(k) for k in names), lists], ["doc", *names, "symbols"])

    return texts.mapInArrow(run, _CUT)


def shared_windows(doc: np.ndarray, start: np.ndarray, size: np.ndarray, symbols: np.ndarray, ptr: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(block, offset, windows, first document, first place) of the runs of windows in blocks, from a suffix array of all their words."""
    gap = np.arange(len(size))  # a symbol of its own parts the blocks
    text = np.zeros(len(symbols) + len(size), np.uint64)
    at = np.arange(len(symbols)) + np.repeat(gap, np.diff(ptr))
    text[at] = symbols.view(np.uint32).astype(U64) + U64(1)
    base = ptr[:-1] + gap
    block = np.repeat(gap, size)
    offset = np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size)
    order = sorted_suffixes(text, base[block] + offset)
    group = np.cumsum(~same_start(text, order, length)) - 1
    window = np.empty(len(text), np.int64)
    window[base[block] + offset] = np.arange(len(block))
    win = window[order]
    d, p = doc[block[win]], start[block[win]] + offset[win]
    by = np.lexsort([p, d, group])
    first = by[np.flatnonzero(np.r_[True, group[by][1:] != group[by][:-1]])]
    fd, fp = np.empty(len(block), np.int64), np.empty(len(block), np.int64)
    fd[win], fp[win] = d[first][group], p[first][group]
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (fd[1:] != fd[:-1]) | (fp[1:] != fp[:-1] + 1)
    s = np.flatnonzero(new)
    return block[s], offset[s], np.diff(np.r_[s, len(block)]), fd[s], fp[s]


_FOUND = "anchor long, content long, offset long, n long, first_doc long, first_v int, first_at long, key long"


def _windows_of(t: pa.Table, length: int) -> pa.RecordBatch:
    """What one suffix array finds in blocks: runs of windows and their first places or, for the blocks of a spread anchor, each window with its hash."""
    doc, v, start, size, anchor, content, cuts = (t[k].to_numpy().astype(np.int64) for k in ("doc", "v", "start", "size", "anchor", "content", "cuts"))
    lists = t["symbols"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = pc.list_flatten(lists).to_numpy()
    ptr = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
    order = np.lexsort([v, doc])  # documents are numbered in their order
    place = np.empty(len(doc), np.int64)
    place[order] = np.cumsum(np.r_[True, (doc[order][1:] != doc[order][:-1]) | (v[order][1:] != v[order][:-1])]) - 1
    some = np.empty(int(place.max(initial=-1)) + 1, np.int64)
    some[place] = np.arange(len(place))
    block, offset, n, fd, fp = shared_windows(place, start, size, flat, ptr, length)
    each = np.where(cuts[block] > 1, n, 1)
    row = np.repeat(np.arange(len(block)), each)
    step = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    spread = cuts[block[row]] > 1
    n = np.where(spread, 1, n[row])
    block, offset, first, fp = block[row], offset[row] + step, some[fd[row]], fp[row] + step
    at = ptr[block] + offset
    sums = prefix(flat.view(np.uint32).astype(U64) + U64(1))
    key = span(sums, at, at + length).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(anchor[block]), pa.array(content[block]), pa.array(offset), pa.array(n), pa.array(doc[first]), pa.array(v[first].astype(np.int32)), pa.array(fp), pa.array(key, mask=~spread)], ["anchor", "content", "offset", "n", "first_doc", "first_v", "first_at", "key"])


def _suffix_sorted(length: int, group_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and salt; whole groups of these go into one suffix array until it is full."""
        held: list[pa.RecordBatch] = []
        total = 0
        for b in tidied(batches):
            if not b.num_rows:
                continue
            held.append(b)
            total += len(pc.list_flatten(b.column(7)))
            if total > group_words:
                t = pa.Table.from_batches(held).combine_chunks()
                a, k = t["anchor"].to_numpy(), t["salt"].to_numpy()
                other = np.flatnonzero((a != a[-1]) | (k != k[-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield _windows_of(t.slice(0, cut), length)
                    held = t.slice(cut).combine_chunks().to_batches()
                    total = sum(len(pc.list_flatten(x.column(7))) for x in held)
        if held:
            yield _windows_of(pa.Table.from_batches(held).combine_chunks(), length)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one document that continue each other, here and at their first place, made one."""
    for b in batches:
        rows = b.column(2)
        size = pc.list_value_length(rows).to_numpy()
        doc, v = np.repeat(b.column(0).to_numpy(), size), np.repeat(b.column(1).to_numpy(), size)
        flat = pc.list_flatten(rows)
        s, e, fd, fv, fp = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("s", "e", "first_doc", "first_v", "first_at"))
        by = np.lexsort([s, fp - s, fv, fd, v, doc])
        doc, v, s, e, fd, fv, fp = doc[by], v[by], s[by], e[by], fd[by], fv[by], fp[by]
        new = np.ones(len(s), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (fd[1:] != fd[:-1]) | (fv[1:] != fv[:-1]) | ((fp - s)[1:] != (fp - s)[:-1]) | (s[1:] > e[:-1])
        at = np.flatnonzero(new)
        last = np.maximum.reduceat(e, at) if len(at) else e
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[at], v[at], s[at], last, fd[at], fp[at])], ["doc_id", "v", "start_word", "end_word", "first_doc_id", "first_start_word"])


def _passages(docs: DataFrame, id_col: str, text_col: str, length: int, group_words: int) -> DataFrame:
    """The repeats, with the version of the row that has each."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    near = written(_blocks(texts, length), "blocks")
    kinds = near.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("content") != F.max("content")).alias("several")).filter("n > 1").drop("n")
    again = written(near.join(kinds, "anchor"), "repeated")
    place = F.struct("doc", "v", "start")
    first = written(again.groupBy("anchor", "content", "several").agg(F.min(place).alias("f"), F.first("size").alias("size")), "first")
    heads = first.filter("several").select("anchor", "content", "f.*", "size")
    cuts = heads.groupBy("anchor").agg(F.ceil(F.sum(F.col("size") + (length - 1)) / group_words).cast("int").alias("cuts"))
    wanted = heads.join(cuts, "anchor").groupBy("doc").agg(F.collect_list(F.struct("v", "start", "size", "anchor", "content", "cuts")).alias("wanted"))  # a document's own blocks
    wanted = written(wanted, "wanted")
    full = with_ids(texts, wanted.select("doc"), id_col="doc").join(wanted, "doc").select("doc", "text", "wanted")
    cut = _block_words(full, length).withColumn("salt", F.pmod("content", "cuts"))
    cut = cut.repartition("anchor", "salt").dropDuplicates(["anchor", "salt", "content"]).sortWithinPartitions("anchor", "salt")
    found = written(cut.mapInArrow(_suffix_sorted(length, group_words), _FOUND), "windows")
    spread = found.filter("key IS NOT NULL").drop("first_doc", "first_v", "first_at")
    least = found.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("first_doc", "first_v", "first_at")).alias("f"))
    every = found.filter("key IS NULL").drop("key").unionByName(spread.join(least, "key").select("anchor", "content", "offset", "n", "f.*"))
    alone = again.filter("NOT several").join(first.filter("NOT several").select("anchor", "content", "f"), ["anchor", "content"])
    alone = alone.select("doc", "v", F.col("start").cast("long").alias("s"), F.col("size").cast("long").alias("n"), F.col("f.doc").alias("first_doc"), F.col("f.v").alias("first_v"), F.col("f.start").cast("long").alias("first_at"))
    mixed = again.filter("several").join(every, ["anchor", "content"]).select("doc", "v", (F.col("start") + F.col("offset")).alias("s"), "n", "first_doc", "first_v", "first_at")
    runs = alone.unionByName(mixed).filter("NOT (doc = first_doc AND v = first_v AND s = first_at)")
    runs = runs.select("doc", "v", F.struct("s", (F.col("s") + F.col("n") + length - 1).alias("e"), "first_doc", "first_v", "first_at").alias("r"))
    rows = runs.groupBy("doc", "v").agg(F.collect_set("r").alias("rs"))  # a document's own runs
    out = written(rows.mapInArrow(_merged, "doc_id long, v int, start_word long, end_word long, first_doc_id long, first_start_word long"), "passages")
    discard(near, again, first, wanted, found)
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_words: int = GROUP_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id, first_start_word) of each repeat: the words [start_word, end_word) of doc_id stood before, from first_start_word of first_doc_id on."""
    return _passages(docs, id_col, text_col, length, group_words).drop("v")


def _without(text: str, begin: np.ndarray, end: np.ndarray) -> str:
    """UTF-8 text without byte ranges, which are sorted and apart."""
    data, out, at = text, [], 0
    for a, b in zip(begin, end):
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode()


def cut_spans(texts: list[str], spans: list[list[tuple[int, int]]]) -> list[str]:
    """The texts without their words in the spans [first, last), and without what stands between those words."""
    out = []
    for t, sp in zip(texts, spans):
        column = pa.array([t], pa.string())
        _, _, start, end = words(column)
        low, raw = text_bytes(column)[0], t.encode()
        if len(low) != len(raw):  # lower case has other lengths: find the words of each character's own lower case
            start, end = _raw_places(t, start, end)
        gone = np.zeros(len(start) + 1, bool)
        for a, b in sp:
            gone[a:b] = True
        edge = np.flatnonzero(np.diff(np.r_[False, gone[:-1], False].astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        stop = np.r_[start, len(raw)]
        out.append(_without(raw, start[first], stop[last]).rstrip() if len(first) else t)
    return out


def _raw_places(t: str, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places in a text for byte places in its lower case, character by character."""
    chars = pa.array(list(t), pa.string())
    low = np.r_[0, np.cumsum(pc.binary_length(pc.utf8_lower(chars)).to_numpy())]
    raw = np.r_[0, np.cumsum(pc.binary_length(chars).to_numpy())]
    return raw[np.searchsorted(low, start, "right") - 1], raw[np.searchsorted(low, end, "left")]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_words: int = GROUP_WORDS) -> DataFrame:
    """The documents with their repeats cut out; one of which no word is left goes. Texts without a repeat stay as they are, and other columns always."""
    found = _passages(docs, id_col, text_col, length, group_words)
    spans = written(found.groupBy("doc_id").agg(F.collect_list(F.struct("v", "start_word", "end_word")).alias("spans")), "spans")
    discard(found)
    names = docs.columns
    id_of = spans.select("doc_id")
    whole = with_ids(docs, id_of, keep=False, id_col=id_col)
    some = with_ids(docs, id_of, keep=True, id_col=id_col)
    work = some.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")).join(spans, F.col(f"row.`{id_col}`") == F.col("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            row, at = b.column(0), [f.name for f in b.schema.field(0).type].index(text_col)
            w, ptr, _, _ = words(row.field(at))
            texts, own = row.field(at).to_pylist(), versions(w, ptr).tolist()
            mine = [[(s["start_word"], s["end_word"]) for s in x if s["v"] == v] for x, v in zip(b.column(1).to_pylist(), own)]
            new = [cut_spans([t], [sp])[0] if sp else t for t, sp in zip(texts, mine)]
            keep = np.array([not sp or any(c.isalnum() for c in t) for t, sp in zip(new, mine)], bool)
            cols = [pa.array(new, row.field(k).type) if k == at else row.field(k) for k in range(row.type.num_fields)]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    return whole.unionAll(work.select("row", "spans").mapInArrow(run, docs.schema))
