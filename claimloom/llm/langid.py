"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled document: tasks emit sums by
(language, bucket) for each batch, which are added up in Spark, so what is
shuffled is bounded by batches x languages x buckets and not by text. The model
is a float32 matrix in blocks of ``BLOCK_LANGS`` languages, each broadcast by
itself; a batch is counted once into sparse rows (text, bucket, count), which
are multiplied with one block after the other, so a scorer holds one block at a
time and there may be any number of languages. The number of buckets is fixed.

Defined cases: a null text or one without any letter (``str.isalpha``) gives
``und`` and score 0; with no labelled document every text gives ``und`` and
score 0; a null language is not learned from; equal posteriors go to the
language first in sort order; repeated rows are counted and told alike; a text's
result does not depend on the other texts of its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, releasing
from .wordhash import by_bytes, mix

#: Lengths of the character n-grams.
NGRAMS = (1, 2, 3)
BUCKET_BITS = 16
#: Languages of one block of the model.
BLOCK_LANGS = 64
SMOOTHING = 0.5
UNKNOWN = "und"
_CHUNK = 200_000


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _grams_by_size(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bucket numbers of all n-grams of a code point sequence, for each length."""
    shift = np.uint64(64 - bits)
    c = codes.astype(np.uint64) + np.uint64(1)
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), np.uint64)
        for n in range(1, max(NGRAMS) + 1):
            h = h[: max(len(c) - n + 1, 0)] * np.uint64(0x100000001B3) + c[n - 1 :]
            if n in NGRAMS:
                out.append((mix(h + np.uint64(n << 56)) >> shift).astype(np.int64))
    return out


def _grams(codes: np.ndarray, bits: int) -> np.ndarray:
    return np.concatenate(_grams_by_size(codes, bits))


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-cased text, in overlapping pieces of bounded size."""
    text = text.lower()
    step, lap = _CHUNK, max(NGRAMS) - 1
    for at in range(0, max(len(text), 1), step):
        part = text[max(at - lap, 0) : at + step]
        yield np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), (lap if at else 0)


def counts_of(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sparse count row (buckets, counts) of a text."""
    total = None
    for codes, lap in _pieces(text):
        got = _grams(codes, bits)
        if lap:  # n-grams that end inside the overlap were counted by the piece before
            seen = _grams(codes[:lap], bits)
            one = np.bincount(got, minlength=1 << bits)
            one -= np.bincount(seen, minlength=1 << bits)
        elif total is None and len(codes) < _CHUNK:
            return np.unique(got, return_counts=True)
        else:
            one = np.bincount(got, minlength=1 << bits)
        total = one if total is None else total + one
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


def sparse_counts(texts: list[str], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse count rows of texts, some at a time: (first text, row from there, bucket, count)."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size == 0 or size + len(texts[to]) <= _CHUNK):
            size += len(texts[to])
            to += 1
        if to == at + 1:
            bucket, n = counts_of(texts[at], bits)
            yield at, np.zeros(len(bucket), np.int64), bucket, n
        else:
            lower = [t.lower() for t in texts[at:to]]
            codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
            row = np.repeat(np.arange(to - at), np.fromiter(map(len, lower), np.int64, to - at))
            keys = []
            for grams in _grams_by_size(codes, bits):
                rows = row[: len(grams)]
                inside = row[len(row) - len(rows) :] == rows  # it ends in the text that it starts in
                keys.append((rows << bits | grams)[inside])
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield at, key >> bits, key & (1 << bits) - 1, n
        at = to


class Model:
    """Log probabilities by blocks of languages: (prior [L], likelihood [buckets, L]), or broadcasts of such pairs."""

    def __init__(self, langs: list[str], bits: int, blocks: list):
        self.langs, self.bits, self.blocks = langs, bits, blocks

    def _block(self, no: int) -> tuple[np.ndarray, np.ndarray]:
        held = self.blocks[no]
        if not isinstance(held, Broadcast):
            return held
        value = held.value
        if len(self.blocks) > 1:
            del held._value  # read again for the next batch: one block is in memory at a time
        return value

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and its posterior for each text of a batch."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        told = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        if not told:
            return out
        rows = list(sparse_counts([texts[i] for i in told], self.bits))
        most, total, best = np.full(len(told), -np.inf), np.zeros(len(told)), np.zeros(len(told), np.int64)
        at = 0
        for no in range(len(self.blocks)):
            log_prior, log_like = self._block(no)
            score = np.tile(log_prior, (len(told), 1))
            for first, row, bucket, n in rows:
                edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                for lang in range(0, len(log_prior), 16):  # bounds the product in memory
                    part = slice(lang, lang + 16)
                    score[first + row[edge], part] += np.add.reduceat(n[:, None] * log_like[bucket, part].astype(np.float64), edge)
            own, place = score.max(1), score.argmax(1)
            higher = own > most  # of equal ones the first stays
            best = np.where(higher, at + place, best)
            top = np.maximum(own, most)
            total = total * np.exp(most - top) + np.exp(score - top[:, None]).sum(1)
            most, at = top, at + len(log_prior)
        for i, b, n in zip(told, best.tolist(), total.tolist(), strict=True):
            out[i] = self.langs[b], float(1.0 / n)
        return out


def _count_batches(bits: int):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}  # counts by bucket of ``BLOCK_LANGS`` languages at most

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, total in held.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["lang", "bucket", "n"])
            held.clear()

        for whole in batches:
            for batch in by_bytes(whole, "text"):
                coded = batch.column(0).dictionary_encode()
                names, own = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                for first, row, bucket, n in sparse_counts([t or "" for t in batch.column(1).to_pylist()], bits):
                    code = own[first + row]
                    for c in np.unique(code).tolist():
                        if names[c] not in held and len(held) >= BLOCK_LANGS:
                            yield from counted()
                        here = code == c
                        held.setdefault(names[c], np.zeros(1 << bits))
                        held[names[c]] += np.bincount(bucket[here], n[here], 1 << bits)
        yield from counted()

    return run


def fit(labelled: DataFrame) -> Model:
    """Fit on all rows of (lang, text) whose language is not null.

    The driver holds the names of the languages and one block of the model at a time.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("lang").isNotNull())
    per_lang = sorted((r[0], r[1]) for r in rows.groupBy("lang").count().collect())
    langs = [x for x, _ in per_lang]
    if not langs:
        return Model([], BUCKET_BITS, [])
    sums = rows.select("lang", "text").mapInArrow(_count_batches(BUCKET_BITS), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "language-counts")
    prior = np.log([n for _, n in per_lang]) - np.log(sum(n for _, n in per_lang))
    blocks = []
    for at in range(0, len(langs), BLOCK_LANGS):
        part = langs[at : at + BLOCK_LANGS]
        got = sums.where(F.col("lang").isin(part)).toArrow()  # BLOCK_LANGS x buckets rows at most
        names = got.column("lang").combine_chunks().dictionary_encode()
        place = np.array([part.index(x) for x in names.dictionary.to_pylist()], np.int64)
        counts = np.zeros((1 << BUCKET_BITS, len(part)), np.float32)
        counts[got.column("bucket").to_numpy(), place[names.indices.to_numpy()]] = got.column("n").to_numpy()
        whole = counts.sum(0, dtype=np.float64) + SMOOTHING * len(counts)
        blocks.append(spark.sparkContext.broadcast((prior[at : at + BLOCK_LANGS], np.log((counts + SMOOTHING) / whole).astype(np.float32))))
    return Model(langs, BUCKET_BITS, blocks)


def predict(docs: DataFrame, model: Model, *, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its posterior, in columns of these names (added, or replaced)."""
    keep = [c for c in docs.columns if c not in names]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    where = keep.index("text")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.predict(batch.column(where).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                names=[*keep, *names],
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def with_letter(docs: DataFrame) -> DataFrame:
    """The rows whose text is not null and has a letter."""
    where = docs.columns.index("text")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([has_letter(t) for t in batch.column(where).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
