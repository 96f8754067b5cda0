"""What the operators share: written tables, checked broadcasts and hashed words.

Words are found and hashed for whole Arrow batches at once, without Python strings. A word is a run of ASCII letters, digits
and non-ASCII characters of the lower-cased text; all else separates words.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_B = 0x9E3779B97F4A7C15
_BINV = pow(_B, -1, 1 << 64)
_STEP = 1 << 19  #: bytes hashed at a time
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: words, and runs of punctuation
TOKENS = np.where(_WORD, 1, 2).astype(np.uint8)
TOKENS[[*range(33), 127]] = 0
_LIBC = ctypes.CDLL(None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_POWERS: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; where that is unset, as in tests, a folder of our own if all executors are on this machine."""
    if not (d := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The rows of df, written once to the shared folder and read again: later steps don't compute them anew, and a lost executor loses nothing.

    What was shuffled to write them goes at once, not when the driver happens to collect its garbage. discard() removes the files of a table that nothing reads any more; what the result of an operator still reads goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables from written() whose readers are done."""
    for t in tables:
        fs, where = _file_system(t.sparkSession, t._written_to)
        fs.delete(where, True)
        fs.cancelDeleteOnExit(where)


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound the bytes of this session's Arrow batches, unless they are bounded closer: 10,000 long texts take gigabytes outside the heap.

    What a function gives doesn't depend on its batches.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not (now and now.isdigit() and int(now) <= most):
        spark.conf.set(key, str(most))


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; after each, what Arrow and the allocator hold for later goes back to the system, as workers stay and share little memory."""
    for b in batches:
        yield b
        del b
        pa.default_memory_pool().release_unused()
        if hasattr(_LIBC, "malloc_trim"):
            _LIBC.malloc_trim(0)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def with_ids(df: DataFrame, ids: DataFrame, keep: bool = True, id_col: str = "doc_id", most_bytes: int = 64 << 20, then: Batches | None = None, schema: str | None = None) -> DataFrame:
    """Rows of df whose id is (keep) or isn't (not keep) in the one column of ids, which has each id once and no null; `then` makes them rows of `schema`.

    Whole-number ids of up to most_bytes go to the executors as one sorted array, so that the texts needn't be shuffled; more, and ids of other types, are joined. Rows with a
    null id count as not in ids.
    """
    small_batches(df.sparkSession)
    name = ids.columns[0]
    if dict(df.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint") or ids.count() * 8 > most_bytes:
        (other,) = fresh(df, "id_")
        rows = df.join(ids.select(F.col(name).alias(other)), df[f"`{id_col}`"] == F.col(other), "left_semi" if keep else "left_anti")
        return rows.mapInArrow(then, schema) if then else rows
    array = np.sort(ids.toArrow().column(0).to_numpy().astype(np.int64))
    sent = df.sparkSession.sparkContext.broadcast(array)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = sent.value
        for b in tidied(batches):
            col = b.column(b.schema.get_field_index(id_col))
            x = pc.fill_null(col, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(have, x)
            hit = (at < len(have)) & (have[np.minimum(at, len(have) - 1)] == x) if len(have) else np.zeros(len(x), bool)
            hit &= np.asarray(col.is_valid())
            yield b.filter(pa.array(hit if keep else ~hit))

    return df.mapInArrow(lambda batches: then(chosen(batches)), schema) if then else df.mapInArrow(chosen, df.schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about `most` bytes of text each; a longer text comes alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n or more powers of the base of the polynomial hash, and their inverses modulo 2**64."""
    if len(_POWERS.get(0, ())) < n:
        m = max(n, _STEP + 1)
        for k, base in ((0, _B), (1, _BINV)):
            p = np.full(m, base, U64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def prefix(x: np.ndarray) -> np.ndarray:
    """Prefix sums from which span() hashes any run of x."""
    p, _ = powers(len(x) + 1)
    out = np.zeros(len(x) + 1, U64)
    np.cumsum(x * p[: len(x)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end) of the array whose prefix sums are given."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U64))


def text_bytes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, one after another, and where each begins and ends; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return buf, at - at[0]


def words(column: pa.Array, kind: np.ndarray = _WORD, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of a column of texts: 64-bit hashes, the first word of each row (and the end), and each word's first and last byte + 1 in text_bytes().

    kind tells bytes apart: a word is a run of bytes of one kind, and kind 0 is between words.
    """
    buf, at = text_bytes(column, lower)
    n = len(buf)
    first = np.zeros(n + 1, bool)
    first[at] = True
    of = kind[buf]
    begins, ends = of != 0, of != 0
    edge = (of[1:] != of[:-1]) | first[1:n]
    begins[1:] &= edge
    ends[:-1] &= edge
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out, i = np.empty(len(start), U64), 0
    while i < len(start):  # in pieces that end with a word, so that memory stays small for a text of any length
        j = max(i + 1, int(np.searchsorted(end, start[i] + _STEP, "right")))
        a, b = start[i], end[j - 1]
        out[i:j] = span(prefix(buf[a:b].astype(U64) + U64(1)), start[i:j] - a, end[i:j] - a)
        i = j
    return out, np.searchsorted(start, at), start, end


def rows_of(ptr: np.ndarray) -> np.ndarray:
    """The row of each element, from the rows' first elements."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def whole_number_id(df: DataFrame, id_col: str) -> Column:
    """The id as a 64-bit number."""
    return F.col(id_col).cast("long")
