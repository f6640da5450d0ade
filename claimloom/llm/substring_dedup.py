"""Removal of word passages that stand in an earlier document, by doubling.

Level 1 looks at windows of half the length. Of the half windows inside each
full window only the one with the least hash counts, so a document keeps about
one in thirteen, yet two equal full windows always keep the same one. Half
windows that one document has alone can't be part of a repeat and end there.

The rest are extended to twice the length. Neighbouring full windows with the
same half form a region; a region that stands whole in an earlier document is
removed at once. Only regions that are the first of their kind are split into
their full windows, which meet those of other first regions. So copies, however
many, cost one row for each region, and no pairs are made. Twice the half is
the length asked for, so no further level follows.

Joins are by hash values of windows and by document. Hot windows (a passage in
very many documents) are aggregated before they are shuffled, and what the
aggregates give is written down first, so that both sides of a join come from
exchanges of their own and Spark can split a hot one. Texts move in compressed form and only where a document
has a repeated half.

Defined cases: a null text has no words; a window only counts as repeated if a
strictly smaller doc_id has it, so rows with equal ids never remove each
other's words; equal rows are cut alike, from one list of places; rows without an id neither lose words nor cause a removal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .wordhash import Rolling, by_bytes, split_words

WINDOW = 50

_HALF = Rolling(0x4A1F)
_FULL = Rolling(0xF011)
_REGION = Rolling(0x4E6)


def least_halves(halves: np.ndarray, window: int, half: int) -> np.ndarray:
    """For each full window of one document the least hash of its half windows."""
    span = window - half + 1
    least, width = halves, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


class _Document:
    """Hashes of one document's windows."""

    def __init__(self, words: np.ndarray, window: int):
        half = window // 2 if window > 1 else 1
        n = len(words)
        at = np.arange(n - half + 1)
        prefix = _HALF.prefix(words)
        self.least = least_halves(_HALF.slices(prefix, at, at + half), window, half)
        self.words, self.window = words, window

    def keys(self) -> np.ndarray:
        return np.unique(self.least).view(np.int64)

    def regions(self, repeated: np.ndarray) -> list[tuple[int, int, int]]:
        """(region hash, first window, windows) for each run with a repeated half."""
        edge = np.flatnonzero(np.r_[True, self.least[1:] != self.least[:-1]])
        size = np.diff(np.r_[edge, len(self.least)])
        hit = np.isin(self.least[edge].view(np.int64), repeated)
        edge, size = edge[hit], size[hit]
        prefix = _REGION.prefix(self.words)
        value = _REGION.slices(prefix, edge, edge + size + self.window - 1)
        return list(zip(value.view(np.int64).tolist(), edge.tolist(), size.tolist(), strict=True))

    def windows(self, start: np.ndarray) -> np.ndarray:
        return _FULL.slices(_FULL.prefix(self.words), start, start + self.window).view(np.int64)


def _per_document(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", 2_000_000):
                w = split_words(batch.column(2))
                data = w.data.tobytes()
                counts, digests, keys = [], [], []
                for a, b, known in zip(w.first[:-1].tolist(), w.first[1:].tolist(), batch.column(0).is_valid().to_pylist(), strict=True):
                    counts.append(b - a)
                    text = data[w.start[a] : w.end[b - 1]] if b > a else b""
                    digests.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                    keys.append(_Document(w.hashes[a:b], window).keys() if known and b - a >= window else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "mark", "n_words", "kept_sha256", "halves"],
                )

    return run


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = [press((t or "").encode()) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "mark", "packed"])


def _words_of(packed: bytes, unpress) -> tuple[np.ndarray, list[bytes]]:
    text = unpress(packed)
    return split_words(pa.array([text]).cast(pa.string())).hashes, text.split()


def _regions(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for doc, mark, packed, halves in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, _ = _words_of(packed, unpress)
                d = _Document(hashes, window)
                for value, start, size in d.regions(np.array(halves, np.int64)):
                    out.append((value, doc, mark, start, size, d.windows(np.arange(start, start + size)).tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (pa.int64(), batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["region", "doc_id", "mark", "start", "size", "windows"])

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, mark, start, windows = batch.columns
        values = [np.frombuffer(x, np.int64) for x in windows.to_pylist()]
        sizes = np.array([len(v) for v in values], np.int64)
        row = np.repeat(np.arange(len(values)), sizes)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start.to_numpy()[row]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)), doc.take(pa.array(row)), mark.take(pa.array(row)), pa.array(place)], names=["window", "doc_id", "mark", "start"])


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for doc, packed, removed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = unpress(packed).split()
                change = np.zeros(len(words) + 1, np.int64)
                for r in removed or ():
                    change[r["start"]] += 1
                    change[r["start"] + r["size"] + window - 1] -= 1
                gone = np.cumsum(change[:-1]) > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out.append((doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def removed_passages(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept_text.

    ``kept_text`` is null where nothing was removed: the text stands as it is.
    ``window`` must be even (or 1), as it is twice the length of level 1.
    """
    if window != 1 and window % 2:
        raise ValueError("window must be even")
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    key = ["doc_id", "mark"]

    rows = materialize(marked.mapInArrow(_per_document(window), f"doc_id {kind}, mark long, n_words long, kept_sha256 string, halves array<long>"), "documents")
    halves = rows.select(*key, F.explode("halves").alias("half"))
    repeated = materialize(halves.groupBy("half").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("half"), "repeated")
    involved = materialize(halves.join(repeated, "half").groupBy(*key).agg(F.collect_set("half").alias("halves")), "involved")

    packed = marked.where("doc_id is not null").mapInArrow(_compressed, f"doc_id {kind}, mark long, packed binary")
    texts = materialize(packed.join(involved, key).select(*key, "packed", "halves"), "texts")

    regions = materialize(texts.mapInArrow(_regions(window), f"region long, doc_id {kind}, mark long, start long, size long, windows binary"), "regions")
    first = materialize(regions.groupBy("region").agg(F.min("doc_id").alias("lo")), "first")
    whole = regions.select("region", *key, "start", "size").join(first, "region").where("doc_id > lo").select(*key, "start", "size")

    own = regions.join(first, "region").where("doc_id = lo").select(*key, "start", "windows")
    windows = materialize(own.mapInArrow(_split, f"window long, doc_id {kind}, mark long, start long"), "windows")
    earliest = materialize(windows.groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("window", "lo"), "earliest")
    single = windows.join(earliest, "window").where("doc_id > lo").select(*key, "start", F.lit(1).cast("long").alias("size"))

    removed = whole.unionByName(single).distinct().groupBy(*key).agg(F.collect_list(F.struct("start", "size")).alias("removed"))
    cut = (
        texts.select(*key, "packed")
        .join(removed, key)
        .select("doc_id", "packed", "removed")
        .mapInArrow(_cut(window), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    )
    same = rows.select(*key, "n_words", "kept_sha256").join(removed.select(*key), key, "left_anti")
    untouched = same.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    return untouched.unionByName(cut)
