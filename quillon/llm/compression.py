"""Quality rule: compression bands.

Whole texts and their chunks of a fixed size are compressed with zstandard. A ratio above the band of its length means repetition
(copied lines, boilerplate, one word over and over), one below it means that there is no language in it (random characters,
encoded binary). What a short text can reach differs from what a long one can, so each length has limits of its own.

Cases: a null or empty text is rejected as "empty". Texts below the first band are too short to tell and stay. A text of any length is read
whole. Repeated rows are judged one by one. Other columns pass through untouched, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quillon.llm.shared import small_batches, tidied

#: (bytes from which it holds, lowest ratio, highest ratio). The lowest ratios lie above what random base64 reaches and, from 256 bytes, random lower-case
#: letters and digits (1.29 at 319 bytes, 1.46 at a kilobyte, 1.53 from 16 KB on), and below all prose at hand. Below 256 bytes short prose reaches no more than such letters do, so only base64 goes.
#: Random hex digits are not aimed at.
BANDS = (
    *((128, 1.06, 2.6), (160, 1.08, 2.6), (192, 1.13, 2.6), (224, 1.2, 2.6), (256, 1.32, 3.2), (320, 1.335, 3.2), (384, 1.39, 3.2), (448, 1.395, 3.2)),
    *((512, 1.42, 3.8), (640, 1.45, 3.8), (768, 1.49, 3.8), (1024, 1.54, 4.2), (2048, 1.56, 4.6), (4096, 1.57, 5.0), (16384, 1.57, 6.0), (65536, 1.6, 7.0)),
)
CHUNK_BYTES = 4096
BAD_SHARE = 0.25  #: a text goes when chunks out of their band hold more than this share of its bytes
LEVEL = 3
FIELDS = "n_bytes long, ratio double, n_chunks int, low_share double, high_share double, verdict string, keep boolean"


def out_of_band(ratio: float, n: int, bands: Sequence[tuple[int, float, float]] = BANDS) -> int:
    """-1, 0 or 1: below, inside or above the band for n bytes."""
    for least, low, high in reversed(bands):
        if n >= least:
            return -1 if ratio < low else int(ratio > high)
    return 0


def judge(data: bytes | None, compressor: zstandard.ZstdCompressor | None = None, bands=BANDS, chunk: int = CHUNK_BYTES, bad_share: float = BAD_SHARE) -> tuple:
    """The values of FIELDS for one text's bytes."""
    if not data:
        return 0, None, 0, None, None, "empty", False
    z = compressor or zstandard.ZstdCompressor(level=LEVEL)
    n, bad = len(data), {-1: 0, 0: 0, 1: 0}
    ratio = n / len(z.compress(data))
    if n <= chunk:
        bad[out_of_band(ratio, n, bands)] += n
    else:
        for i in range(0, n, chunk):
            part = data[i : i + chunk]
            bad[out_of_band(len(part) / len(z.compress(part)), len(part), bands)] += len(part)
    low, high, whole = bad[-1] / n, bad[1] / n, out_of_band(ratio, n, bands)
    verdict = "repetitive" if whole > 0 or high > bad_share and whole == 0 else "incompressible" if whole < 0 or low > bad_share else "keep"
    return n, ratio, -(-n // chunk), low, high, verdict, verdict == "keep"


def _judged(batch: pa.RecordBatch, text_col: str, z: zstandard.ZstdCompressor) -> list[tuple]:
    col = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary())
    return [judge(memoryview(x.as_buffer()) if x.is_valid else None, z) for x in col]


def compression_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id, the figures and the verdict."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=LEVEL)
        for b in tidied(batches):
            cols = list(zip(*_judged(b, text_col, z))) or [[]] * 7
            kinds = (pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.bool_())
            arrays = [b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_bytes", "ratio", "n_chunks", "low_share", "high_share", "verdict", "keep"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {FIELDS}")


def compression_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rule keeps, with all their columns; no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=LEVEL)
        for b in tidied(batches):
            yield b.filter(pa.array([x[-1] for x in _judged(b, text_col, z)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
