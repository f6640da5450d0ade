"""Chunking of documents: overlapping word windows, disjoint groups, paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions import tokens as tk
from ..storage import pieces, releasing

#: Windows of one batch.
WINDOWS = 1024
#: The bytes that part words.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_windows(docs: DataFrame, *, size: int = config.CHUNK_WORDS, overlap: int = config.CHUNK_OVERLAP, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, chunk_index, chunk_id, text, *keep): windows of ``size`` words, the last may be short.

    An overlap of 0 means none. A text without words gives no chunk.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and larger than the overlap")
    rest = docs.select(key, *keep, "text")
    fields = rest.schema.fields[:-1]
    schema = T.StructType([*fields, T.StructField("chunk_index", T.LongType()), T.StructField("text", T.StringType())])
    found = rest.mapInArrow(_windows(size, size - overlap), schema)
    return found.select(key, "chunk_index", F.concat(F.col(key).cast("string"), F.lit(":"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text", *keep)


def _windows(size: int, step: int):
    """Windows of the last column's words, cut from its bytes; the other columns are repeated."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(batch.num_columns - 1)
            raw, at = tk.bytes_of(texts)
            blank = _BLANK[raw]
            # a word begins at the start of a row or after a blank, and ends before one or with the row
            begins, ends = ~blank, ~blank
            begins[1:] &= blank[:-1]
            ends[:-1] &= blank[1:]
            rows = at[:-1][np.diff(at) > 0]
            begins[rows] = ~blank[rows]
            rows = at[1:][np.diff(at) > 0] - 1
            ends[rows] = ~blank[rows]
            starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            # the words with one blank after each that has one: a window is a slice of them
            raw = raw.copy()
            raw[blank] = 0x20
            kept = ~blank
            kept[1:] |= ~blank[:-1]
            joined = raw[kept].data
            after = np.zeros(len(starts) + 1, np.int64)
            followed = np.append(kept, False)[stops] & np.append(blank, False)[stops]
            np.cumsum(stops - starts + followed, out=after[1:])
            first = np.searchsorted(starts, at)
            n = np.diff(first)
            many = np.where(n > 0, 1 + np.maximum(-(-(n - size) // step), 0), 0)
            row = np.repeat(np.arange(len(n)), many)
            index = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            lo = first[row] + index * step
            hi = np.minimum(lo + size, first[row] + n[row])
            lo, hi = after[lo], after[hi - 1] + (stops - starts)[hi - 1]
            for cut in range(0, len(row), WINDOWS):
                own = slice(cut, cut + WINDOWS)
                offsets = np.append(0, np.cumsum(hi[own] - lo[own])).astype(np.int32)
                data = b"".join([joined[x:y] for x, y in zip(lo[own].tolist(), hi[own].tolist(), strict=True)])
                text = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                repeated = [c.take(pa.array(row[own])) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*repeated, pa.array(index[own]), text], names=[*batch.schema.names[:-1], "chunk_index", "text"])

    return run


def disjoint_groups(docs: DataFrame, *, size: int = config.DISJOINT_WORDS, key: str = "doc_id") -> DataFrame:
    return word_windows(docs, size=size, overlap=0, key=key)


def paragraph_chunks(docs: DataFrame, *, size: int = config.PARAGRAPH_CHARS, overlap: int = config.PARAGRAPH_OVERLAP, key: str = "doc_id") -> DataFrame:
    """Paragraphs packed up to ``size`` characters; a chunk starts with the tail of the one before.

    Packing depends on what was packed before, so it is a fold for each document.
    """

    def pack(text: str) -> list[str]:
        out, held = [], ""
        for part in (p.strip() for p in text.replace("\r\n", "\n").split("\n\n")):
            if not part:
                continue
            if held and len(held) + 2 + len(part) > size:
                out.append(held)
                tail = held[-overlap:] if overlap else ""
                tail = tail[tail.find(" ") + 1 :] if " " in tail else tail
                held = f"{tail}\n\n{part}" if tail else part
            else:
                held = f"{held}\n\n{part}" if held else part
        return [*out, held] if held else out

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            packed = [pack(t or "") for t in batch.column(1).to_pylist()]
            at = [(row, i) for row, chunks in enumerate(packed) for i in range(len(chunks))]
            keys = batch.column(0).take(pa.array([row for row, _ in at], pa.int64()))
            ids = [f"{k}_chunk_{i}" for k, (_, i) in zip(keys.to_pylist(), at, strict=True)]
            texts = [c for chunks in packed for c in chunks]
            yield pa.RecordBatch.from_arrays([keys, pa.array([i for _, i in at], pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=[key, "chunk_index", "chunk_id", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, chunk_index long, chunk_id string, text string")
