"""Sparse and dense retrieval, fusion, merging and reranking, for sets of queries."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import text as tx
from ..functions import tokens as tk
from ..storage import releasing, written
from . import containment


#: Vectors of one block, and what rounding to six digits can join.
DENSE_BLOCK = 8192
TIE = 2e-6
#: Chunks, and queries, of one matrix product of BM25, and terms of one step of it; a place takes two bytes.
SCORED, TERMS = 512, 4096
#: Places of the bitmap of query terms; a driver holds one number for each at most.
SLOTS = 1 << 20


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side whose row count was looked up and is small."""
    return F.broadcast(df) if rows <= config.BROADCAST_ROWS else df


def term_counts(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, term, tf, dl) of each chunk's terms, and a row without a term for each chunk; no shuffle."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, 1024):
            names, term, chunk, tf, length = tk.counted(batch.column(1))
            n = batch.num_rows
            keys = pa.concat_arrays([batch.column(0).take(pa.array(chunk)), batch.column(0)])
            terms = pa.concat_arrays([names.cast(pa.string()).take(pa.array(term)), pa.nulls(n, pa.string())])
            yield pa.RecordBatch.from_arrays([keys, terms, pa.array(np.concatenate([tf, np.zeros(n, np.int64)])), pa.array(np.concatenate([length[chunk], length]).astype(np.int64))], names=[key, "term", "tf", "dl"])

    kind = chunks.select(key).schema[0].dataType.simpleString()
    return chunks.select(key, "text").mapInArrow(run, f"`{key}` {kind}, term string, tf long, dl long")


def postings(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, term, tf, dl): term counts and the length of each chunk in tokens."""
    return term_counts(chunks, key).where("term IS NOT NULL")


def chunk_terms(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, term): the distinct terms of each chunk, without a shuffle."""
    return chunks.select(key, F.explode(F.array_distinct(tx.search_tokens("text"))).alias("term"))


def term_stats(posted: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf) with idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    return posted.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def doc_stats(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    return chunks.select(key, F.size(tx.search_tokens("text")).cast("long").alias("dl"))


def top_k(scored: DataFrame, query: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query, with their rank from 1."""
    rank = F.row_number().over(W.partitionBy(query).orderBy(*order))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def bm25_topk(chunks: DataFrame, queries: DataFrame, *, k: int = config.SPARSE_K, query: str = "query_id", key: str = "chunk_id", digits: int = 6) -> DataFrame:
    """(query, key, score, rank): BM25; repeated query terms count each time.

    Chunks are split into tokens once. Only terms of the queries are kept from
    them; those of ``SCORED`` chunks are one row, which meets packs of as many
    queries as a matrix product. What leaves it are the ``k`` best of each query.
    """
    asked = queries.select(query, F.explode(tx.search_tokens("text")).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qtf"))
    asked = written(asked.groupBy(query).agg(F.collect_list(F.struct("term", "qtf")).alias("terms")).withColumn("no", F.monotonically_increasing_id()), "asked")  # the terms of one query
    each = asked.select("no", F.inline("terms"))
    slots = each.select((F.crc32("term") % SLOTS).cast("int").alias("slot")).distinct().toArrow().column(0).to_numpy()  # SLOTS numbers at most
    kind = chunks.select(key).schema[0].dataType.simpleString()
    blocks = written(chunks.select(key, "text").mapInArrow(_term_blocks(slots), f"ids array<{kind}>, dls array<int>, terms array<string>, sizes array<int>, places binary, tfs binary"), "term-blocks")
    total = blocks.select(F.size("ids").alias("n"), F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens")).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).first()
    n = int(total["n"] or 0)
    avgdl = float(total["tokens"] / n if n else 0.0) or 1.0
    df = F.col("df")
    counted = blocks.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("sizes").alias("df")))).groupBy("term").agg(F.sum("df").alias("df"))
    idf = counted.select("term", F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5)).alias("idf"))
    shape = asked.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms")).first()
    weighted = each.join(idf, "term").select("no", "term", (F.col("qtf") * F.col("idf") * (config.BM25_K1 + 1)).alias("weight"))
    packs = weighted.groupBy("no").agg(F.collect_list("term").alias("q_terms"), F.collect_list("weight").alias("q_weights"))
    packs = packs.groupBy(F.pmod(F.xxhash64("no"), F.lit(-(-int(shape["n"]) // SCORED) or 1)).alias("pack")).agg(F.collect_list(F.struct("no", "q_terms", "q_weights")).alias("p"))  # ``SCORED`` queries on average
    column = lambda c: F.transform("p", lambda x: x[c])
    packs = written(packs.select(column("no").alias("nos"), F.transform(column("q_terms"), F.size).alias("held"), F.flatten(column("q_terms")).alias("asked"), F.flatten(column("q_weights")).alias("weights")), "query-packs")
    # some 64 pairs in a task, as what a task is sent in one batch are rows and not bytes
    pairs = (n // SCORED + 1) * (int(shape["n"]) // SCORED + 1)
    met = blocks.repartition(max(pairs // 64, chunks.sparkSession.sparkContext.defaultParallelism)).crossJoin(sized(packs, int(shape["terms"] or 0)))
    found = met.mapInArrow(_best_of_terms(key, k, avgdl), f"no long, `{key}` {kind}, score double").withColumn("score", F.round("score", digits))
    return top_k(found.where("score > 0"), "no", k, F.desc("score"), F.asc(key)).join(sized(asked.select("no", query), int(shape["n"])), "no").select(query, key, "score", "rank")


def _term_blocks(slots: np.ndarray):
    """One row for each ``SCORED`` chunks: their ids and lengths, and the postings of terms that fall into the slots."""
    wanted = np.zeros(SLOTS, bool)
    wanted[slots] = True

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, SCORED):
            names, term, chunk, tf, length = tk.counted(batch.column(1))
            kept = wanted[[zlib.crc32(t.encode()) % SLOTS for t in names.to_pylist()]] if len(names) else np.zeros(0, bool)
            term, chunk, tf = (x[kept[term]] for x in (term, chunk, tf))
            first = np.flatnonzero(np.diff(term, prepend=-1))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [one(batch.column(0)), one(pa.array(length.astype(np.int32))), one(names.cast(pa.string()).take(pa.array(term[first]))), one(pa.array(np.diff(np.append(first, len(term))).astype(np.int32))), pa.array([chunk.astype("<u2").tobytes()]), pa.array([tf.astype("<u4").tobytes()])],
                names=["ids", "dls", "terms", "sizes", "places", "tfs"],
            )

    return run


def _best_of_terms(key: str, k: int, average: float):
    """For each pair of a block of chunks and a pack of queries the ``k`` best chunks of each query."""
    k1, b = config.BM25_K1, config.BM25_B

    def best(row: pa.RecordBatch) -> pa.RecordBatch:
        cell = lambda c: row.column(c)[0].values
        dl = cell("dls").to_numpy().astype(float)
        sizes, held = cell("sizes").to_numpy(), cell("held").to_numpy()
        place, tf = np.frombuffer(row.column("places")[0].as_py(), "<u2"), np.frombuffer(row.column("tfs")[0].as_py(), "<u4").astype(float)
        part = tf / (tf + k1 * (1 - b + b * dl[place] / average))
        row_of = {t: i for i, t in enumerate(cell("terms").to_pylist())}
        at = np.array([row_of.get(t, -1) for t in cell("asked").to_pylist()], np.int64)
        of, weight = np.repeat(np.arange(len(held)), held)[at >= 0], cell("weights").to_numpy()[at >= 0]
        at, ends = at[at >= 0], np.concatenate([[0], np.cumsum(sizes)])
        score = np.zeros((len(held), len(dl)))
        for lo in range(0, len(sizes), TERMS):
            hi = min(lo + TERMS, len(sizes))
            here, mine = slice(ends[lo], ends[hi]), (at >= lo) & (at < hi)
            matrix, weights = np.zeros((hi - lo, len(dl))), np.zeros((len(held), hi - lo))
            matrix[np.repeat(np.arange(hi - lo), sizes[lo:hi]), place[here]] = part[here]
            weights[of[mine], at[mine] - lo] = weight[mine]
            score += weights @ matrix
        # what may tie with the last one after rounding stays
        bar = np.partition(score, -k, axis=1)[:, -k] - TIE if len(dl) > k else np.zeros(len(held))
        q, c = np.nonzero((score >= bar[:, None]) & (score > 0))
        return pa.RecordBatch.from_arrays([cell("nos").take(pa.array(q)), cell("ids").take(pa.array(c)), pa.array(score[q, c])], names=["no", key, "score"])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield best(batch.slice(i, 1))

    return run


def normalized(v: str) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def best_of_block(width: int, k: int):
    """For each block (vectors of kind 0, then packs of queries of kind 1) the k best by a matrix product."""

    def cell(column: pa.ListArray, i: int) -> np.ndarray:
        lo, hi = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
        return column.values.to_numpy()[lo:hi]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, rows, vectors = None, [], [], None
        for batch in batches:
            of, kind, names, values = (batch.column(c) for c in ("block", "kind", "ids", "values"))
            for i in range(batch.num_rows):
                if of[i].as_py() != block:
                    block, ids, rows, vectors = of[i].as_py(), [], [], None
                asked, matrix = cell(names, i), cell(values, i).reshape(-1, width)
                if not kind[i].as_py():
                    ids.append(asked)
                    rows.append(matrix)
                    continue
                if vectors is None:
                    vectors = np.concatenate(rows) if rows else np.zeros((0, width))
                    own = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                score = matrix @ vectors.T
                score[asked[:, None] == own] = -np.inf
                # one decimal more than the rounding of scores can join: all that may tie stay
                bar = np.partition(score, -k, axis=1)[:, -k] - TIE if score.shape[1] > k else np.full(len(asked), -1e300)
                q, v = np.nonzero(score >= np.maximum(bar, -1e300)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(own[v]), pa.array(score[q, v])], names=["query_id", "vec_id", "score"])

    return run


def dense_topk(vectors: DataFrame, queries: DataFrame, *, k: int = config.DENSE_K, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, score, rank) by exact cosine, for a stated query set.

    Vectors that are shorter than the widest count as if filled up with zeros;
    those that are null, empty or hold a null or no finite number take no part.
    Vectors are dealt to blocks of ``DENSE_BLOCK``; queries are packed, and each
    pack meets each block as one matrix product. What leaves a block are its best
    ``k`` of each query and what ties with the last of them after rounding.
    """
    count = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    width, blocks = max(int(count["width"] or 1), 1), max(1, -(-int(count["n"]) // DENSE_BLOCK))

    def packs(rows: DataFrame, by: Column, size: int) -> DataFrame:
        sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        filled = F.concat(normalized("embedding"), F.array_repeat(F.lit(0.0), width - F.size("embedding")))
        unit = rows.where((F.size("embedding") > 0) & sound).select(F.col("vec_id").cast("long").alias("vec_id"), filled.alias("u"), by.cast("int").alias("block"))
        lot = unit.withColumn("lot", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-DENSE_BLOCK // size)))))
        packed = lot.groupBy("block", "lot").agg(F.collect_list(F.struct("vec_id", "u")).alias("p"))  # ``size`` rows on average
        return packed.select("block", F.transform("p", lambda x: x["vec_id"]).alias("ids"), F.flatten(F.transform("p", lambda x: x["u"])).alias("values"))

    dealt = packs(vectors, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)), 512).select("block", F.lit(0).alias("kind"), "ids", "values")
    asked = packs(queries, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)), 512).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "ids", "values")
    both = dealt.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind")
    scored = both.mapInArrow(best_of_block(width, k), "query_id long, vec_id long, score double").withColumn("score", F.round("score", digits))
    return top_k(scored, "query_id", k, F.desc("score"), F.asc("vec_id"))


def fuse(hits: DataFrame, *, query: str = "query_id", key: str = "chunk_id", rrf_k: int = config.RRF_K, k: int = config.RETRIEVE_LIMIT, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of rank lists (query, key, rank): every occurrence adds."""
    fused = hits.groupBy(query, key).agg(F.round(F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))), digits).alias("rrf"), F.min("rank").alias("best_rank"))
    return top_k(fused, query, k, F.desc("rrf"), F.asc("best_rank"), F.asc(key)).withColumnRenamed("rank", "fused_rank")


def backfilled(hits: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """One row for each key: the first value of each column that isn't blank, in order."""
    picks = [F.min_by(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col(c)), F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col(order))).alias(c) for c in columns]
    return hits.groupBy(*keys).agg(*picks)


def merge_by_priority(parts: list[DataFrame], *, query: str, key: str, order: str, limit: int = config.MERGED_LIMIT) -> DataFrame:
    """Lists joined in order of priority; the first of each key stays; then the limit."""
    ranked = parts[0].withColumn("priority", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        ranked = ranked.unionByName(p.withColumn("priority", F.lit(i)), allowMissingColumns=True)
    first = ranked.withColumn("n", F.row_number().over(W.partitionBy(query, key).orderBy("priority", order))).where("n = 1").drop("n")
    return top_k(first, query, limit, F.asc("priority"), F.asc(order), F.asc(key)).withColumnRenamed("rank", "position")


def rerank(candidates: DataFrame, score: Column, *, query: str, k: int, fused: str = "fused_rank") -> DataFrame:
    """Order by a pair score; equal scores keep their fused order."""
    return top_k(candidates.withColumn("rerank_score", score), query, k, F.desc("rerank_score"), F.asc(fused)).withColumnRenamed("rank", "reranked")


def hybrid(sparse: Callable[[], DataFrame], dense: Callable[[], DataFrame], *, whole: bool = False) -> tuple[DataFrame, str]:
    """Rank lists of both backends; one may fail, which the status tells, both failing raises.

    ``whole``: for callers that can't pass the status on; any failure is raised as it is.
    """
    found, failed = [], []
    for name, backend in (("dense", dense), ("sparse", sparse)):
        try:
            # written here: what fails while it runs fails inside the try
            found.append(written(backend().select("query_id", "chunk_id", "rank"), f"{name}-ranks"))
        except Exception as error:  # noqa: BLE001 - a backend may fail in any way
            if whole:
                raise
            failed.append(f"{name}:{type(error).__name__}")
    if not found:
        raise RuntimeError("error:" + ";".join(failed))
    lists = found[0]
    for f in found[1:]:
        lists = lists.unionByName(f)
    return lists, f"warning:{failed[0]}" if failed else "ok"


def target_chunks(chunks: DataFrame, targets: DataFrame, *, limit: int = config.TARGET_METADATA_LIMIT) -> DataFrame:
    """Chunks whose name key holds, or is held by, a target's; in document order, limited.

    Distinct names meet distinct targets through ``containment.contained``, in
    both directions.
    """
    keyed = chunks.withColumn("name_key", tx.compact("case_name"))
    names = written(keyed.select("name_key").where("name_key <> ''").distinct(), "names")
    asked = written(targets.select("query_id", tx.compact("target").alias("target_key")).where("target_key <> ''"), "targets")
    wanted = asked.select("target_key").distinct()

    def within(texts: DataFrame, keys: DataFrame) -> DataFrame:
        of, by = texts.columns[0], keys.columns[0]
        found = containment.contained(texts.select(F.col(of).alias("text_id"), F.col(of).alias("text")), keys.select(F.col(by).alias("key")))
        return found.select(F.col("text_id").alias(of), F.col("key").alias(by))

    pairs = within(names, wanted).unionByName(within(wanted, names)).distinct().join(asked, "target_key")
    return top_k(keyed.join(pairs, "name_key"), "query_id", limit, F.asc("doc_id"), F.asc("chunk_index"), F.asc("chunk_id"))
