"""I-Match fingerprints: hashes of randomised subsets of a lexicon.

The lexicon holds the terms (runs of bytes other than white space, A-Z in lower
case) whose inverse document frequency lies in a band. Its upper end leaves out
terms of one document, and terms that take less than one in ``MAX_TERMS`` of all
(document, term) pairs, so at most ``MAX_TERMS`` terms can be in the band,
however large the corpus is; the lower end leaves out terms of more than
``COMMON`` of the documents. Frequencies are counted over all rows.

Of a text its distinct terms of the lexicon are kept and sorted. ``FAMILIES``
seeds shuffle the lexicon, and a subset is what stands before a point of such an
order; the points are a fixed ladder with four steps for each halving. A text
takes the first subset of the ladder that holds any of its terms, so short and
long texts have one or two terms in each, and the sum of the hashes of these
terms is one part of its fingerprint. Two texts are as alike as the share of
parts that are equal, which follows the overlap of their terms; equal texts
have equal fingerprints.

Defined cases: a null text is an empty one; a text without a term of the lexicon
has parts made of the hash of its whole text, so it is like its copies alone.
Each row gives one row, also for repeated and null ids; the order of documents
is that of their ids, nulls first, and of their texts' hashes within one id.
After the last document comes the first, which may be the same one. Other
columns are not looked at. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import materialize, releasing
from .wordhash import by_bytes, mix, seeded, split_words

FAMILIES = 64
MAX_TERMS = 1 << 20
#: Terms of more than this share of the documents are too common.
COMMON = 0.05
STEP_BYTES = 2_000_000

#: Odd numbers: each puts the terms, whose hashes are mixed already, in another order.
_SEEDS = seeded(FAMILIES, 0x1A7C) | np.uint64(1)


def _pairs(texts: pa.Array, band: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, term), sorted; of the terms in ``band`` alone, if given."""
    w = split_words(texts, lower=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
    terms, ids = np.unique(w.hashes, return_inverse=True)
    if band is not None:
        held = _in_band(terms, band)
        doc, ids = doc[held[ids]], ids[held[ids]]
    pairs = np.unique(doc * max(len(terms), 1) + ids)
    return pairs // max(len(terms), 1), terms[pairs % max(len(terms), 1)]


def _in_band(term: np.ndarray, band: np.ndarray) -> np.ndarray:
    if not len(band):
        return np.zeros(len(term), bool)
    return band[np.minimum(np.searchsorted(band, term), len(band) - 1)] == term


def frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): in how many rows a term stands."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                term, n = np.unique(_pairs(batch.column(0))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "df"])

    return docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame) -> Broadcast:
    """The sorted hashes of the terms in the band: 8 MB at most."""
    spark = docs.sparkSession
    counts = materialize(frequencies(docs), "term-frequencies")
    pairs = counts.agg(F.sum("df")).first()[0] or 0
    band = counts.where((F.col("df") >= max(2, -(-pairs // MAX_TERMS))) & (F.col("df") <= COMMON * docs.count()))
    terms = band.select("term").toArrow().column("term").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(np.sort(terms))


def parts(texts: pa.Array, band: np.ndarray) -> np.ndarray:
    """Fingerprints as an array of texts by families of 16-bit values."""
    doc, term = _pairs(texts, band)
    out = np.zeros((len(texts), FAMILIES), np.uint64)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    some, of = doc[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
    value = mix(term ^ np.uint64(0x51F7))
    for k, seed in enumerate(_SEEDS):
        if not len(first):
            break
        place = term * seed
        # the point of the ladder after the least place: its two bits below the leading one, rounded up
        least = np.minimum.reduceat(place, first)
        shift = np.maximum(np.frexp(least.astype(np.float64))[1] - 3, 0).astype(np.uint64)
        point = (least >> shift) + np.uint64(1)
        inside = (place >> shift[of]) < point[of]
        out[some, k] = np.add.reduceat(np.where(inside, value, np.uint64(0)), first)
    bare = np.ones(len(texts), bool)
    bare[some] = False
    for i in np.flatnonzero(bare).tolist():
        out[i] = xxhash.xxh3_64_intdigest((texts[i].as_py() or "").encode())
    return (mix(out ^ _SEEDS) >> np.uint64(48)).astype(np.uint16)


def spelled(fingerprints: np.ndarray) -> pa.Array:
    width = 4 * FAMILIES
    text = fingerprints.astype(">u2").tobytes().hex().encode()
    offsets = np.arange(len(fingerprints) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.string(), len(fingerprints), [None, pa.py_buffer(offsets), pa.py_buffer(text)])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame, lexicon: Broadcast) -> DataFrame:
    """(doc_id, fingerprint) per row of (doc_id, text)."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", STEP_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0), spelled(parts(batch.column(1), lexicon.value))], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("fingerprint", T.StringType())]))


_COMPARED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: pa.Array, texts: pa.Array, following: pa.Array, band: np.ndarray) -> list[pa.Array]:
    """Columns of ``_COMPARED`` after the ids; ``following`` holds the next document's text of each row."""
    edited, length = [], []
    for text, after in zip(texts.to_pylist(), following.to_pylist(), strict=True):
        cut = len(text) // 4
        length.append(len(text))
        edited.append(text[: len(text) - cut] + after[:cut])
    # a row is mostly the next one of the row before, so each text is looked at once
    both = pa.concat_arrays([texts, following[-1:]]) if texts[1:].equals(following[:-1]) else pa.concat_arrays([texts, following])
    own = parts(both, band)
    nxt = own[1:] if len(both) == len(texts) + 1 else own[len(texts) :]
    own, new = own[: len(texts)], parts(pa.array(edited, pa.string()), band)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
    return [ids, pa.array(length, pa.int64()), pa.array(sha, pa.string()), spelled(own), spelled(new), pa.array(likeness(own, new)), pa.array(likeness(own, nxt))]


def next_to_next(docs: DataFrame, lexicon: Broadcast) -> DataFrame:
    """Per row of (doc_id, text): its fingerprint, that of its text with the last quarter
    of the code points replaced by the first ones of the next document, and likenesses.

    Rows are dealt by ranges of ids and each task reads its range in order, one
    row ahead. The first and last row of each range come out with their texts
    and meet in a second, small step.
    """
    kind = docs.schema["doc_id"]
    names = ["doc_id", *(f.name for f in T._parse_datatype_string(_COMPARED).fields)]
    full = T.StructType([kind, *T._parse_datatype_string(f"{_COMPARED}, task int, end string, end_text string").fields])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        arrow = [kind_of, *(pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]

        def loose(ids: pa.Array, texts: pa.Array, end: str) -> pa.RecordBatch:
            empty = [pa.nulls(1, t) for t in arrow[1:]]
            return pa.RecordBatch.from_arrays([ids, *empty, pa.array([task], pa.int32()), pa.array([end]), texts], names=full.names)

        ids = texts = None
        for whole in batches:
            for batch in by_bytes(whole, "text", STEP_BYTES):
                if ids is None:
                    yield loose(batch.column(0)[:1], batch.column(1)[:1], "first")
                    ids, texts = batch.column(0), batch.column(1)
                else:
                    ids, texts = pa.concat_arrays([ids, batch.column(0)]), pa.concat_arrays([texts, batch.column(1)])
                if len(ids) > 1:
                    done = _compared(ids[:-1], texts[:-1], texts[1:], lexicon.value)
                    n = len(ids) - 1
                    yield pa.RecordBatch.from_arrays([*done, pa.array([task] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=full.names)
                    ids, texts = ids[-1:], texts[-1:]
        if ids is not None:
            yield loose(ids, texts, "last")

    @releasing
    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(_compared(row.column(0), row.column(1), row.column(2), lexicon.value), names=names)

    kind_of = to_arrow_type(kind.dataType)
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = texts.withColumn("order", F.xxhash64("text")).repartitionByRange("doc_id", "order").sortWithinPartitions("doc_id", "order", "text")
    rows = materialize(ranged.select("doc_id", "text").mapInArrow(run, full), "fingerprints")
    tasks = sorted(r[0] for r in rows.where("end = 'first'").select("task").collect())  # one number for each task
    follows = spark.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1], strict=True)), "task int, next int")
    last = rows.where("end = 'last'").select("task", "doc_id", "end_text")
    first = rows.where("end = 'first'").select(F.col("task").alias("next"), F.col("end_text").alias("next_text"))
    ends = last.join(follows, "task").join(first, "next").select("doc_id", "end_text", "next_text")
    closed = ends.mapInArrow(join_ends, T.StructType([kind, *T._parse_datatype_string(_COMPARED).fields]))
    return rows.where("end IS NULL").select(*names).unionByName(closed)
