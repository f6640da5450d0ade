"""Which texts hold which keys, as an equi-join: each text is read once, however many keys there are.

Of each key one stretch of at most eight letters stands for it: the one that the
fewest keys share. Its bytes are a 64-bit number. Texts look up the numbers at
all of their places in a bitmap of fixed size, made of all keys, and only places
that may be hits leave the task, with the letters around them; they meet the
keys on the number, and the whole key is compared.

Texts and keys are of ASCII characters, as ``text.compact`` and ``citations.key``
make them; others never match. Null or empty texts and keys match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written

GRAM = 8
#: Places of the bitmap; a driver holds one number for each at most.
SLOTS = 1 << 20


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


def anchors(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, code, size, offset): of each key its rarest gram among all keys."""
    plain = keys.select(F.col(key).alias("key")).where((F.col("key") != "") & ~F.col("key").rlike(r"[^\x01-\x7f]")).distinct()
    size = F.least(F.length("key"), F.lit(GRAM))
    grams = plain.select("key", size.alias("size"), F.posexplode(F.transform(F.sequence(F.lit(1), F.length("key") - size + 1), lambda i: F.substring("key", i, size))).alias("offset", "gram"))
    coded = grams.select("key", "size", "offset", F.conv(F.hex("gram"), 16, 10).cast("long").alias("code"))
    shared = coded.groupBy("code").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("key").orderBy("n", "offset"))
    return coded.join(shared, "code").withColumn("r", rank).where("r = 1").select("key", "code", "size", "offset")


def _hits(sizes: list[int], reach: int, slots: np.ndarray):
    bitmap = np.zeros(SLOTS, bool)
    bitmap[slots] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            _, offsets, data = texts.buffers()
            at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
            at = at - at[0]
            for size in sizes:
                n = len(raw) - size + 1
                if n <= 0:
                    continue
                codes = np.zeros(n, np.int64)
                for j in range(size):
                    codes = (codes << 8) | raw[j : j + n]
                place = np.flatnonzero(bitmap[_slot(codes)])
                of = np.searchsorted(at, place, side="right") - 1
                whole = place + size <= at[of + 1]
                place, of = place[whole], of[whole]
                lo, hi = np.maximum(place - reach, at[of]), np.minimum(place + reach, at[of + 1])
                around = [raw[a:b].tobytes().decode("ascii", "replace") for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(codes[place]), pa.array((place - lo).astype(np.int32)), pa.array(around, pa.string())], names=["text_id", "code", "inside", "around"])

    return run


def contained(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(text_id, key) for every text (text_id, text) that holds a key (key), once each."""
    anchored = written(anchors(keys), "anchors")
    shape = anchored.agg(F.max(F.length("key")).alias("reach"), F.array_sort(F.collect_set("size")).alias("sizes")).first()  # GRAM sizes at most
    kind = texts.schema["text_id"].dataType.simpleString()
    if not shape["reach"]:
        return texts.select("text_id", F.lit("").alias("key")).limit(0)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(batch.column(0).to_numpy())))], names=["slot"])

    taken = anchored.select("code").mapInArrow(slots, "slot long").distinct().toArrow().column(0).to_numpy()  # SLOTS numbers at most
    plain = texts.where(F.col("text") != "").select("text_id", "text")
    hits = plain.mapInArrow(_hits(list(shape["sizes"]), int(shape["reach"]), taken), f"text_id {kind}, code long, inside int, around string")
    met = hits.join(anchored, "code").where((F.col("inside") >= F.col("offset")) & (F.substring("around", F.col("inside") - F.col("offset") + 1, F.length("key")) == F.col("key")))
    return met.select("text_id", "key").distinct()
