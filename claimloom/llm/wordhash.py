"""Vectorised word splitting and hashing over Arrow string arrays.

A word is a maximal run of bytes outside a separator class; documents never
share a word. All hashes are 64-bit and depend only on the bytes of the words,
never on the separators between them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1

#: Byte classes; True marks a byte that belongs to a word.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_OR_HIGH = np.zeros(256, dtype=bool)
ALNUM_OR_HIGH[0x30:0x3A] = True
ALNUM_OR_HIGH[0x61:0x7B] = True
ALNUM_OR_HIGH[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values for a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & _MASK))


class Rolling:
    """Hashes of slices of a value sequence from one prefix sum.

    The slice [i, j) hashes to sum(v[k] * P**(k - i)); prefix sums are divided
    by P**i through the inverse of P modulo 2**64.
    """

    def __init__(self, seed: int):
        self.base = int(seeded(1, seed)[0]) | 1
        self._up = np.ones(1, dtype=np.uint64)
        self._down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up))
            self._up = self._grow(self.base, size)
            self._down = self._grow(pow(self.base, -1, 1 << 64), size)
        return self._up[:n], self._down[:n]

    @staticmethod
    def _grow(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        up, _ = self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self._powers(len(prefix))
        return mix((prefix[end] - prefix[start]) * down[start])


_BYTE_VALUES = seeded(256, 0x5EED)
_BYTES_TO_WORD = Rolling(0xB17E)


@dataclass
class Words:
    """Words of a batch: document i owns words ``first[i]`` to ``first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its int64 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def split_words(column: pa.Array, *, lower: bool = False, inside: np.ndarray = NOT_SPACE, hashed: bool = True) -> Words:
    """Split and hash the words of every text of a string array."""
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    word = np.zeros(n + 2, dtype=bool)
    word[1:-1] = inside[data]
    begins = word[1:-1] & ~word[:-2]
    ends = word[1:-1] & ~word[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = word[1:-1][cuts]
    ends[cuts - 1] = word[1:-1][cuts - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    hashes = np.zeros(0, np.uint64)
    if hashed:
        prefix = _BYTES_TO_WORD.prefix(_BYTE_VALUES[data])
        hashes = _BYTES_TO_WORD.slices(prefix, start, end)
    return Words(hashes, first, start, end, data)


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = 6_000_000):
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def take_words(w: Words, words: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts of chosen words joined by one space: text i gets ``words[first[i]:first[i + 1]]``."""
    length = w.end[words] - w.start[words] + 1
    ends = np.concatenate([[0], np.cumsum(length)])
    raw = np.concatenate([w.data, np.zeros(1, np.uint8)])[np.arange(ends[-1]) - np.repeat(ends[:-1] - w.start[words], length)]
    raw[ends[1:] - 1] = 0x20
    last = first[1:][np.diff(first) > 0]  # no space after the last word of a text
    keep = np.ones(len(raw), bool)
    keep[ends[last] - 1] = False
    full = np.diff(first) > 0
    offsets = ends[first] - np.concatenate([[0], np.cumsum(full)])
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[keep])]).cast(pa.string())


def exact_ids(w: Words) -> np.ndarray:
    """Numbers of the words of a batch, equal if and only if their bytes are equal.

    Words are grouped by hash and every word is compared, byte for byte, with
    one word of its group; only if two words should clash are they told apart
    by their bytes alone.
    """
    order = np.argsort(w.hashes)
    ranked = w.hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new) - 1
    head = order[new][ids]
    length = w.end - w.start
    if (length == length[head]).all():
        ends = np.cumsum(length)
        step = np.arange(ends[-1] if len(ends) else 0)
        if np.array_equal(w.data[step - np.repeat(ends - length - w.start, length)], w.data[step - np.repeat(ends - length - w.start[head], length)]):
            return ids
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w.text(i), len(seen)) for i in range(len(order))], np.int64)
