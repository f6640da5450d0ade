"""Audit of how filters interact, by a look-up of the first failure.

Five filters can be applied in 120 orders. A document is a mask of the filters
it fails, and a table of 32 masks by 120 orders tells at which step of an order
a document of that mask goes. One pass over the masks indexes the table in
numpy and adds up removals by part, order, step and label with ``np.bincount``;
each partition returns one array of counts for each part, and these partial
arrays are summed in two steps. All figures follow from those sums and the counts of masks.

Four filters look at one text alone. The last fails a text that is equal to the
text of a smaller id anywhere in the table; equality is that of SHA-256. The
least id of each text is found by a partial aggregate, and rows meet it on the
text's digest and the id together, so a text with many copies is spread.

Defined cases: a null text is an empty one; a row without an id never fails the
last filter and makes no other row fail it, nor do rows of one id; a null part
is the empty string; documents without labels count as neither good nor toxic,
and of several labels of one id the greatest counts. Other columns are not
looked at. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, releasing
from .wordhash import by_bytes, exact_ids, split_words, text_bytes

FILTERS = "ABCDE"
ORDERS = ["".join(x) for x in itertools.permutations(FILTERS)]
STEPS = len(FILTERS)
#: Labels: bit 0 good, bit 1 toxic.
LABELS = 4
#: Parts whose counts a task holds at once; beyond that it returns what it has and goes on.
HELD_PARTS = 256

#: Lanes in which the arrays of a part are summed first.
MERGE_LANES = 64

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
SYMBOLS = b"#$%&*|"


def first_failures() -> np.ndarray:
    """32 masks by 120 orders: the step (from 0) that removes, or 5 where none does."""
    fails = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS)) & 1
    place = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    by_step = fails[:, place]
    return np.where(by_step.any(axis=2), by_step.argmax(axis=2), STEPS)


def text_masks(batch: pa.Array) -> np.ndarray:
    """Which of the filters A to D each text of an array fails, as bits 0 to 3."""
    data, offsets = text_bytes(batch)
    of = lambda marked: np.diff(np.concatenate([[0], np.cumsum(marked)])[offsets])
    points = of((data & 0xC0) != 0x80)
    upper = of((data >= 0x41) & (data <= 0x5A))
    symbol = of(np.isin(np.arange(256), list(SYMBOLS))[data])
    w = split_words(batch)
    words = np.diff(w.first)
    doc = np.repeat(np.arange(len(words)), words)
    ids = exact_ids(w)
    pairs = np.sort(doc * (int(ids.max(initial=0)) + 1) + ids)
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = pairs[1:] != pairs[:-1]
    distinct = np.diff(np.concatenate([[0], np.cumsum(fresh)])[w.first])  # pairs are sorted by document first
    return (words < MIN_WORDS) | (100 * distinct < MIN_DISTINCT_PERCENT * words) << 1 | (100 * upper > MAX_UPPER_PERCENT * points) << 2 | (symbol > 0) << 3


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) per row of (doc_id, text, ``part``): the filters it fails, A as bit 0 to E as bit 4."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text_masks(batch.column(3)).astype(np.int32)), batch.column(2)], names=["doc_id", "part", "alone", "digest"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    rows = materialize(rows.mapInArrow(run, f"doc_id {kind}, part string, alone int, digest binary"), "filter-masks")
    named = rows.where(F.col("doc_id").isNotNull())
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("is_first"))
    judged = named.join(firsts, ["digest", "doc_id"], "left").withColumn("mask", F.col("alone") + F.when(F.col("is_first"), 0).otherwise(16))
    return judged.select("doc_id", "part", "mask").unionByName(rows.where(F.col("doc_id").isNull()).select("doc_id", "part", F.col("alone").alias("mask")))


_COUNTS = "part string, removed array<long>, seen array<long>"


class Held:
    """Sums of arrays by part, of ``HELD_PARTS`` parts at most; with more of them, what is held leaves first."""

    def __init__(self):
        self.sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, part: str, removed: np.ndarray, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
        if part in self.sums:
            mine = self.sums[part]
            mine[0][:] += removed
            mine[1][:] += seen
            return
        if len(self.sums) >= HELD_PARTS:
            yield from self.rest()
        self.sums[part] = (removed.astype(np.int64), seen.astype(np.int64))

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.sums:
            lists = [pa.array([x[i] for x in self.sums.values()], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(list(self.sums), pa.string()), *lists], names=["part", "removed", "seen"])
        self.sums = {}


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order and step; ``labels`` has (doc_id, quality, toxic)."""
    table = first_failures()
    cells = len(ORDERS) * (STEPS + 1) * LABELS
    lanes = np.arange(len(ORDERS)) * (STEPS + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                coded = piece.column(0).dictionary_encode()
                no, mask, label = coded.indices.to_numpy(), piece.column(1).to_numpy(), piece.column(2).to_numpy()
                step = table[mask]  # documents by orders
                for k, name in enumerate(coded.dictionary.to_pylist()):
                    here = no == k
                    removed = np.bincount(((lanes + step[here]) * LABELS + label[here, None]).ravel(), minlength=cells)
                    yield from held.add(name, removed, np.bincount(mask[here], minlength=1 << STEPS))
        yield from held.rest()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in batches:
            for i, name in enumerate(batch.column(0).to_pylist()):
                yield from held.add(name, *(batch.column(c)[i].values.to_numpy() for c in (1, 2)))
        yield from held.rest()

    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 2).otherwise(0)).alias("bad"))
    rows = masks(docs, part)
    named = rows.where(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left").select("part", "mask", F.coalesce(F.col("good") + F.col("bad"), F.lit(0)).alias("label"))
    rows = named.unionByName(rows.where(F.col("doc_id").isNull()).select("part", "mask", F.lit(0).alias("label")))
    # arrays of one part meet in two steps, so no task gets those of all tasks
    partial = rows.mapInArrow(count, _COUNTS).repartition("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_LANES))).mapInArrow(merge, _COUNTS)
    partial = materialize(partial.repartition("part").mapInArrow(merge, _COUNTS), "filter-counts")

    def summed(column: str) -> DataFrame:
        cell = partial.select("part", F.posexplode(column).alias("at", "n")).where("n > 0")
        return cell.groupBy("part", "at").agg(F.sum("n").alias("n"))

    def total(when):
        return F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))

    mask = F.col("at")
    alone = [(c, 1 << i) for i, c in enumerate(FILTERS)]
    seen = summed("seen").groupBy("part").agg(
        F.sum("n").alias("n_docs"),
        F.array(*[total(mask.bitwiseAND(bit) != 0) for _, bit in alone]).alias("fails"),
        F.array(*[total(mask == bit) for _, bit in alone]).alias("only"),
    )
    label, cell = F.col("at") % LABELS, F.floor(F.col("at") / LABELS)
    gone = (
        summed("removed")
        .select("part", F.floor(cell / (STEPS + 1)).cast("int").alias("order"), (cell % (STEPS + 1) + 1).cast("int").alias("step"), label.alias("label"), "n")
        .groupBy("part", "order", "step")
        .agg(F.sum("n").alias("removed"), total(F.col("label").bitwiseAND(1) != 0).alias("good_lost"), total(F.col("label").bitwiseAND(2) != 0).alias("toxic_lost"))
    )
    names = F.array(*[F.lit(x) for x in ORDERS])  # fixed: the orders of five filters
    grid = seen.select("part", "n_docs", "fails", "only", F.posexplode(names).alias("order", "filter_order"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step"))
    full = grid.join(gone, ["part", "order", "step"], "left").fillna(0, ["removed", "good_lost", "toxic_lost"])
    place = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1)))
    full = full.withColumn("filter", place)
    return full.select(
        "part",
        "filter_order",
        "step",
        (F.col("n_docs") - F.sum("removed").over(W.partitionBy("part", "order").orderBy("step"))).alias("kept"),
        "removed",
        (F.get("fails", F.col("filter") - 1) - F.col("removed")).alias("redundant"),
        F.get("only", F.col("filter") - 1).alias("unique_fails"),
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(W.partitionBy("part", "filter")).alias("shapley"),
    )
