"""Periodic runs of words by the runs theorem.

A run is a stretch of words that repeats with a smallest period ``q``, holds at
least ``min_exponent`` periods and ``min_length`` words and can't be extended
with that period. By the runs theorem every run holds a Lyndon root: a longest
Lyndon word, under the order of the words or under its reverse, that starts in
the run and has the length of the period. So, for all texts of a batch at once:

1. suffixes are sorted, each text by itself, by prefix doubling that goes on
   with those suffixes only that are not told apart yet;
2. the longest Lyndon word at a place ends at the next smaller value of the
   inverse suffix array, and at the next greater one under the reverse order
   (the end of the text counts as a word, the least in the first order and the
   greatest in the other, so each run has its root in exactly one of the two);
3. each root (i, q) is extended by the longest common prefix of the suffixes at
   i and i + q, to the left by bisection on the same look-up. Common prefixes
   are least values over the LCP array, by a sparse table of its blocks.

A root with a whole root on its left is left out, so a run comes up once. Roots
whose common prefix is too short for a run of ``min_exponent`` periods are left
out too; that needs at least two periods.

Defined cases: a null text is an empty one, without words or runs; each row of
the input gives one row, also for repeated ids and null ids; other columns are
not looked at. A text is never cut: memory is about 12 bytes for each word and
doubling step, and the number of steps is the logarithm of the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import releasing
from .wordhash import by_bytes, exact_ids, split_words, take_words

#: Bytes of text whose suffixes are sorted at once, one text at least.
STEP_BYTES = 1_500_000

RUNS = "array<struct<start: long, length: long, period: long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Suffixes:
    """Suffix order of several sequences, each closed by an end mark.

    Sequence d owns places ``first[d] + d`` to ``first[d + 1] + d``, the last of
    which is its end mark. ``rank`` is the inverse suffix array; the ranks of a
    sequence follow those of the sequences before it.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray, least: int):
        count = np.diff(first)
        n, total = len(ids), len(ids) + len(count)
        doc = np.repeat(np.arange(len(count)), count + 1)
        self.end = (first[1:] + np.arange(len(count)))[doc]  # place of the end mark
        key = np.zeros(total, np.int64)
        key[np.arange(n) + doc[self.end != np.arange(total)]] = ids + 1
        key += doc * (int(ids.max(initial=0)) + 2)
        order = np.argsort(key)
        rank, slots = self._ranked(order, key[order], np.arange(total), np.empty(total, np.int32))
        self.levels = [rank.copy()]
        step = 1
        while len(slots):
            at = order[slots]
            pair = rank[at].astype(np.int64) * total + rank[at + step]
            by = np.argsort(pair)
            order[slots] = at[by]
            rank, slots = self._ranked(order, pair[by], slots, rank)
            self.levels.append(rank.copy())
            step *= 2
        self.order, self.rank = order, rank
        self._prefixes(least)

    @staticmethod
    def _ranked(order, keys, slots, rank):
        """Ranks of the places in ``slots`` by their sorted keys, and the slots that are not settled."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        rank[order[slots]] = slots[new][np.cumsum(new) - 1]
        alone = new.copy()
        alone[:-1] &= new[1:]
        return rank, slots[~alone]

    def same_start(self, i: np.ndarray, j: np.ndarray, level: int) -> np.ndarray:
        """Whether two suffixes share their first 2 ** level words."""
        level = min(level, len(self.levels) - 1)
        return self.levels[level][i] == self.levels[level][j]

    def _prefixes(self, least: int) -> None:
        """The LCP array, without the places where it is under ``least``."""
        here = np.flatnonzero(self.same_start(self.order[:-1], self.order[1:], least.bit_length() - 1)) + 1
        i, j = self.order[here - 1].copy(), self.order[here].copy()
        lcp = np.zeros(len(here), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            more = (self.levels[level][i] == self.levels[level][j]) << level
            lcp += more
            i += more
            j += more
        enough = lcp >= least
        kept = np.zeros(len(self.order), np.int64)
        kept[here[enough]] = 1
        self.kept = np.cumsum(kept)
        self.table = Least(lcp[enough])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes i and j, i != j; 0 where under ``least``."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        lo, hi = self.kept[a], self.kept[b]
        out = np.zeros(len(a), np.int64)
        solid = hi - lo == b - a
        out[solid] = self.table.between(lo[solid], hi[solid])
        return out


class Least:
    """Least value of values[lo:hi] for many ranges at once: blocks and a sparse table over them."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        size = -(-len(values) // self.BLOCK)
        full = np.full(size * self.BLOCK, np.iinfo(np.int64).max)
        full[: len(values)] = values
        full = full.reshape(size, self.BLOCK)
        self.values = values
        self.from_left = np.minimum.accumulate(full, axis=1).ravel()
        self.to_right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        self.rows = [full.min(axis=1)]
        while 2 << len(self.rows) - 1 <= size:
            half = 1 << len(self.rows) - 1
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Ranges must not be empty."""
        left, right = lo // self.BLOCK, (hi - 1) // self.BLOCK
        out = np.minimum(self.to_right[lo], self.from_left[hi - 1])
        near = np.flatnonzero(left == right)
        if len(near):
            at, stop = lo[near].copy(), hi[near]
            low = self.values[at]
            for _ in range(self.BLOCK - 1):
                at = np.minimum(at + 1, stop - 1)
                low = np.minimum(low, self.values[at])
            out[near] = low
        span = right - left - 1
        for level, row in enumerate(self.rows):
            here = np.flatnonzero((span >= 1 << level) & (span < 2 << level))
            if len(here):
                out[here] = np.minimum(out[here], np.minimum(row[left[here] + 1], row[right[here] - (1 << level)]))
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a value that is not greater, or the length.

    All places hop along the answers found so far; the few that need many hops
    climb and descend a tree of least values, so no order of values is slow.
    """
    n = len(values)
    after = np.append(values, np.iinfo(values.dtype).min)
    nxt = np.arange(1, n + 1)
    todo = np.arange(n)
    for _ in range(24):
        todo = todo[after[nxt[todo]] > values[todo]]
        if not len(todo):
            return nxt
        nxt[todo] = nxt[nxt[todo]]
    size = 1 << n.bit_length()
    tree = [np.full(size, np.iinfo(values.dtype).min, values.dtype)]
    tree[0][: n + 1] = after
    while len(tree[-1]) > 1:
        tree.append(tree[-1].reshape(-1, 2).min(axis=1))
    at, want = nxt[todo], values[todo]
    found = np.full(len(todo), -1)
    for level, low in enumerate(tree[:-1]):
        odd = (found < 0) & (at >> level & 1 == 1)
        node = np.minimum(at >> level, len(low) - 1)
        hit = odd & (low[node] <= want)
        found[hit] = level
        at = np.where(odd & ~hit, at + (1 << level), at)
    for level in range(len(tree) - 2, -1, -1):
        down = found > level
        at = np.where(down & (tree[level][np.minimum(at >> level, len(tree[level]) - 1)] > want), at + (1 << level), at)
    nxt[todo] = at
    return nxt


def runs_of(ids: np.ndarray, first: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, ...]:
    """(sequence, start, length, period) of all runs, by sequence, start and period."""
    if not len(ids):
        return (np.zeros(0, np.int64),) * 4
    least = min_exponent - 1  # a leftmost root of period q has a common prefix of (min_exponent - 2) * q + 1 at least
    s = Suffixes(ids, first, least)
    found = []
    for values in (s.rank, -s.rank):
        at = np.arange(len(s.rank))
        period = next_smaller(values) - at
        fits = period * (min_exponent - 1) <= s.end - at
        at, period = at[fits], period[fits]
        alike = s.same_start(at, at + period, least.bit_length() - 1)
        at, period = at[alike], period[alike]
        right = s.common(at, at + period)
        long = right > (min_exponent - 2) * period
        found.append((at[long], period[long], right[long]))
    at, period, right = (np.concatenate(x) for x in zip(*found, strict=True))
    begin = s.end[at] - (np.diff(first)[s_doc := np.searchsorted(first[1:] + np.arange(len(first) - 1), at)])
    # to the left: the least place at most one period away from which the match still reaches this root
    lo, hi = np.maximum(at - period, begin), at.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        reaches = s.common(mid, mid + period[open_]) >= at[open_] - mid + right[open_]
        hi[open_[reaches]] = mid[reaches]
        lo[open_[~reaches]] = mid[~reaches] + 1
    length = at + right + period - hi
    good = (at - hi < period) & (length >= np.maximum(min_length, min_exponent * period))
    rows = np.unique(np.stack([s_doc[good], (hi - begin)[good], period[good], length[good]]), axis=1)
    return rows[0], rows[1], rows[3], rows[2]


def find(docs: DataFrame, *, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """Per row of (doc_id, text): n_words, its runs by start and period, and the text
    with all but the first period of each run dropped, words joined by one space."""
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")

    @releasing
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", STEP_BYTES):
                w = split_words(batch.column(1))
                doc, start, length, period = runs_of(exact_ids(w), w.first, min_length, min_exponent)
                runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUNS.value_type))
                of = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                edge = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(edge, w.first[doc] + start + period, 1)
                np.add.at(edge, w.first[doc] + start + length, -1)
                kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.diff(w.first).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), runs).cast(_RUNS),
                        take_words(w, kept, np.searchsorted(kept, w.first)),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed_text"],
                )

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(f"n_words long, runs {RUNS}, collapsed_text string").fields])
    return docs.select("doc_id", "text").mapInArrow(search, schema)
