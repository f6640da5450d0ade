"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are put into classes by the number of their word shingles. Each class has
its own number of hash functions, and an item keeps the shingle that is least
under each of them. The share of these that a document holds is an unbiased
estimate of the item's containment in it, however long the document is; a
document with at least ``least`` of them is a candidate, where ``least`` is set
for each class so that true containment at the threshold is missed with
probability under ``MISS``. Candidates are confirmed on the full shingle sets,
as text.

Only DataFrame functions are used. Documents are scanned in place: their
shingles meet the kept ones in a join whose small side is broadcast if it has
at most ``BROADCAST_ROWS`` rows and shuffled otherwise, and what leaves a task
are sums by document and item.

Items with fewer words than a shingle are one shingle, their whole sequence, as
short as they are; for each such length that occurs documents are searched for
their words in a row, as text.

Defined cases: a null text has no words; items without words match nothing, and
documents with fewer words than an item's shingle do not hold it; of repeated items each is reported; rows that
share a doc_id are searched separately and reported once, with the larger
share; rows without a doc_id are searched too.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

SIZE, PERCENT = 5, 80
MISS = 1e-9
BROADCAST_ROWS = 200_000
#: Hash functions for items of up to so many shingles (None: any).
CLASSES = ((16, 24), (64, 32), (256, 48), (None, 64))


def least_agreeing(hashes: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Largest m such that fewer than m of ``hashes`` agree with probability under ``miss``."""
    p, total = percent / 100, 0.0
    for m in range(hashes + 1):
        total += comb(hashes, m) * p**m * (1 - p) ** (hashes - m)
        if total > miss:
            return max(m, 1)
    return hashes


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[ \t-\r]+"), "")


def _windows(source: str, size: int, make) -> Column:
    n = F.size(source)
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), make)).otherwise(F.array())


def shingle_hashes(words: str, size: int) -> Column:
    """Hashes of all shingles of an array of word hashes."""
    return F.array_distinct(_windows(words, size, lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(size)])).cast("array<bigint>"))


def shingle_texts(words: str, size: int) -> Column:
    return F.array_distinct(_windows(words, size, lambda i: F.array_join(F.slice(F.col(words), i + 1, size), " ")).cast("array<string>"))


def _hashed(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, shingle): the distinct shingle hashes of every row."""
    hashes = df.select(*keys, F.transform(words_of("text"), lambda w: F.xxhash64(w)).alias("hashes"))
    return hashes.select(*keys, F.explode(shingle_hashes("hashes", size)).alias("shingle"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained(docs: DataFrame, items: DataFrame, *, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Pairs of (doc_id, text) rows and (item_id, text) items contained in them.

    Columns: doc_id, mark (hash of the text), item_id, n_item, n_shared.
    """
    short = items.select("item_id", words_of("text").alias("words")).where(F.size("words").between(1, size - 1))
    lengths = sorted(r[0] for r in short.select(F.size("words")).distinct().collect())  # fewer than a shingle has words
    out = _contained(docs, items, size, percent)
    for n in lengths:
        wanted = short.where(F.size("words") == n).select("item_id", F.array_join("words", " ").alias("shingle"))
        words = docs.select("doc_id", F.xxhash64("text").alias("mark"), words_of("text").alias("words")).where(F.size("words") >= n)
        held = words.select("doc_id", "mark", F.explode(shingle_texts("words", n)).alias("shingle"))
        hits = held.join(_small(wanted, wanted.count()), "shingle").distinct()
        out = out.unionByName(hits.select("doc_id", "mark", "item_id", F.lit(1).cast("long").alias("n_item"), F.lit(1).cast("long").alias("n_shared")))
    return out


def _contained(docs: DataFrame, items: DataFrame, size: int, percent: int) -> DataFrame:
    docs = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    items = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text"))
    items = materialize(items, "items")

    parts = materialize(_hashed(items, ["item"], size), "item-shingles")
    sizes = parts.groupBy("item").agg(F.count("*").alias("n_item"))
    hashes, least = F.lit(None).cast("int"), F.lit(None).cast("int")
    for top, n in reversed(CLASSES):
        hashes = F.lit(n) if top is None else F.when(F.col("n_item") <= top, n).otherwise(hashes)
        least = F.lit(least_agreeing(n, percent)) if top is None else F.when(F.col("n_item") <= top, least_agreeing(n, percent)).otherwise(least)
    classed = sizes.select("item", "n_item", hashes.alias("hashes"), least.alias("least"))
    kept = (
        parts.join(classed, "item")
        .select("item", "shingle", F.explode(F.sequence(F.lit(1), F.col("hashes"))).alias("no"))
        .groupBy("item", "no")
        .agg(F.min_by("shingle", F.xxhash64("shingle", "no")).alias("shingle"))
        .groupBy("shingle", "item")
        .agg(F.count("*").alias("weight"))
    )
    kept = materialize(kept, "minima")
    classed = materialize(classed, "classes")
    n_items = classed.count()

    key = ["doc_id", "mark"]
    hits = _hashed(docs, key, size).join(_small(kept, kept.count()), "shingle").groupBy(*key, "item").agg(F.sum("weight").alias("agreeing"))
    found = materialize(hits.join(_small(classed, n_items), "item").where("agreeing >= least").select(*key, "item", "n_item"), "candidates")

    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"k.{k}")) for k in key]
    keys = found.select(*key).distinct()
    chosen = docs.alias("d").join(_small(keys, keys.count()).alias("k"), same[0] & same[1], "left_semi")
    n_parts = parts.count()
    texts = items.select("item", words_of("text").alias("words")).select("item", F.explode(shingle_texts("words", size)).alias("shingle"))
    of_docs = chosen.select(*key, words_of("text").alias("words")).select(*key, F.explode(shingle_texts("words", size)).alias("shingle")).distinct()
    shared = of_docs.join(_small(texts, n_parts), "shingle").groupBy(*key, "item").agg(F.count("*").alias("n_shared"))
    pairs = shared.alias("d").join(found.distinct().alias("k"), same[0] & same[1] & (F.col("d.item") == F.col("k.item")))
    return (
        pairs.where(100 * F.col("n_shared") >= percent * F.col("n_item"))
        .select("d.doc_id", "d.mark", F.col("d.item").alias("item"), "n_item", "n_shared")
        .join(items.select("item", "item_id"), "item")
        .select("doc_id", "mark", "item_id", "n_item", "n_shared")
    )


def pairs(docs: DataFrame, items: DataFrame, *, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row for each document id and item id: n_item, n_shared, containment."""
    found = contained(docs, items, size=size, percent=percent)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_item", "m.n_shared", "m.containment")


def without_leaks(docs: DataFrame, items: DataFrame, *, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold none of the items."""
    leaks = contained(docs, items, size=size, percent=percent).select("doc_id", "mark").distinct()
    mark = F.xxhash64(F.col("d.text"))
    return docs.alias("d").join(leaks.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (mark == F.col("k.mark")), "left_anti")
