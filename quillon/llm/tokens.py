"""Token counts: batch encoding in Arrow functions that give back lengths only.

Texts are cut into pieces at places where the tokenizer's pattern always begins a new match (a space or line break after a letter or
digit), so the pieces' counts add up to the text's own. Pieces go to the tokenizer in batches of about equal bytes, whatever the rows are.

Cases: a null text has a null count, an empty one 0. A text without a safe place is encoded in one piece. Repeated rows are counted one
by one. Other columns are never read; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import tiktoken
from pyspark.sql import DataFrame

from quillon.llm.shared import small_batches, tidied

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the public pattern that goes with byte-level vocabularies of 50,000 ids
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_CHARS = 1 << 15
BATCH_BYTES = 1 << 20
_SAFE = re.compile(r"(?<=[^\W_])[ \n]")
_ENCODERS: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoder(vocabulary: bytes, key: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file's content, made once for each Python worker."""
    if (key, pattern) not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS[key, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key, pattern]


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Parts of a text that are tokenized alone as within it, of `most` characters or up to the next safe place."""
    at = 0
    while len(text) - at > most and (m := _SAFE.search(text, at + most)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def counted(texts: list[str | None], enc: tiktoken.Encoding, batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS) -> list[int | None]:
    """The token count of each text."""
    counts, batch, rows, size = np.zeros(len(texts), np.int64), [], [], 0

    def flush() -> None:
        if batch:
            lengths = [len(x) for x in enc.encode_ordinary_batch(batch, num_threads=1)]
            np.add.at(counts, rows, lengths)
            batch.clear(), rows.clear()

    for i, t in enumerate(texts):
        for p in pieces(t, piece_chars) if t else ():
            batch.append(p)
            rows.append(i)
            size += len(p)
            if size >= batch_bytes:
                flush()
                size = 0
    flush()
    return [None if t is None else int(c) for t, c in zip(texts, counts)]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: its id, the columns of `extra`, n_bytes and n_tokens.

    The vocabulary file (a parameter; under 1 MB) is read on the driver and sent to the executors; its size doesn't depend on the data.
    """
    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value, vocabulary, pattern)
        for b in tidied(batches):
            text = b.column(b.num_columns - 1)
            n_bytes = text.cast(pa.large_binary())
            n = counted(text.to_pylist(), enc)
            sizes = pa.compute.cast(pa.compute.binary_length(n_bytes), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], sizes, pa.array(n, pa.int64())], [id_col, *extra, "n_bytes", "n_tokens"])

    kinds = dict(docs.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *extra))
    return docs.select(id_col, *extra, text_col).mapInArrow(run, f"{fields}, n_bytes long, n_tokens long")
