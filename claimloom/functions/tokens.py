"""Search tokens of Arrow batches, counted in numpy: the rule of ``text.search_tokens`` without a row for each token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins (none for null)."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of an array of texts, and the number of tokens of each text (0 for null)."""
    raw, at = bytes_of(texts)
    inside = _INSIDE[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = at[1:-1][(at[1:-1] < len(raw)) & (at[1:-1] > 0)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    # what is left when all other bytes go is one token after the other
    bounds = np.append(0, np.cumsum(np.flatnonzero(ends) + 1 - starts))
    kept = _LOWER[raw[inside]]
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    return found, np.diff(np.searchsorted(starts, at))


def counted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dictionary, term, text, tf, length): counts by term and text, sorted so, and the tokens of each text."""
    found, length = tokens(texts)
    coded = found.dictionary_encode()
    text = np.repeat(np.arange(len(texts)), length)
    pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * max(len(texts), 1) + text, return_counts=True)
    return coded.dictionary, pairs // max(len(texts), 1), pairs % max(len(texts), 1), tf, length


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of exactly ``rows`` rows and a last one, in the order of the rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        cut = whole.num_rows - whole.num_rows % rows
        for at in range(0, cut, rows):
            yield whole.slice(at, rows).combine_chunks().to_batches()[0]
        held = whole.slice(cut).to_batches()
    rest = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
    yield from (b for b in rest if b.num_rows)
