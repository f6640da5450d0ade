"""Exact top-k search by inner product with MaxScore.

Terms are vector dimensions and postings are the values of a dimension in a
shard. A term's contribution q[d] * x[d] lies between bounds that the shard's
least and greatest value give. Each query orders its terms by score bound and
splits them: the non-essential ones are the last terms whose bounds together
add at most ``SLACK`` of the query's threshold. A query whose bounds together
stay below its threshold skips the shard. Postings of essential terms are
traversed for all vectors of the shard, as one product for a batch of queries;
the others are probed, term by term, only for vectors whose partial score plus
the bounds not yet probed still reaches the threshold. Shards are merged by a
ranking of their candidates.

Both sides are distributed. Vectors are dealt to blocks by their nearest pivot,
so that the vectors of a shard look alike and its bounds are tight; a pivot with
many vectors has many blocks. Queries are packed, ``QUERY_BLOCK`` to a row, and
each pack goes to every block of vectors, where it streams past them: a task
holds one block and one pack. Pivots and the first thresholds of the queries
come from a sample of at most ``SAMPLE_CELLS`` numbers, so what is broadcast is
bounded; the result does not depend on the sample.

Defined cases: vectors that are null or hold null or non-finite components take
no part; shorter vectors count as padded with zeros; scores are exact, by
integers of any width where products of the greatest components could pass 61
bits; a component or a found score without a 64-bit form is an error, as in the
SQL; repeated rows are candidates each (equal ones are searched once, with their
count), but rows with the query's own id are not; of repeated query ids the
least vector asks; ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize

#: Queries of one packed row.
QUERY_BLOCK = 512
#: Vectors of one block on average, and of one shard at most.
BLOCK = 16384
SHARD = 4096
#: Queries that are multiplied at once.
BATCH = 128
PIVOTS = 32
SAMPLE_CELLS = 1 << 18
#: Share of the threshold that non-essential terms may add.
SLACK = 0.15
#: Scores below this bound are exact in 64 bits, differences of them too.
_SAFE = 1 << 61
#: The threshold of a query that has no k-th score yet.
_NONE = -_SAFE


def integer_vectors(df: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every usable vector."""
    v = F.col("embedding")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = lambda x: F.lit(scale) * x.cast("double")
    whole = F.transform(v, lambda x: F.when(F.abs(scaled(x)) < float(1 << 63), F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a component has no 64-bit form")).cast("long")))
    return df.where(usable & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list<long> array as one matrix of ``width`` columns."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    all_offsets = column.offsets.to_numpy()
    lengths = np.minimum(np.diff(all_offsets), width)
    out = np.zeros((len(column), width), np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), lengths)
    col = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, col] = values[all_offsets[:-1][row] + col]
    return out


class Shard:
    """Postings of up to some thousand vectors, by dimension; ``copies`` are the rows of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: int, copies: np.ndarray | None = None):
        self.ids = ids
        self.copies = np.ones(len(ids), np.int64) if copies is None else copies
        self.greatest = int(np.abs(vectors).max(initial=0)) * vectors.shape[1]
        bound = self.greatest * most
        #: The smallest type in which all sums are exact, and the bound of its integers.
        self.type, self.exact = (np.float32, 1 << 24) if bound < 1 << 24 else (np.float64, 1 << 53) if bound < 1 << 53 else (np.int64, 1 << 62)
        self.postings = np.ascontiguousarray(vectors.T).astype(self.type)
        self.low, self.high = vectors.min(0, initial=0), vectors.max(0, initial=0)

    def search(self, queries: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (query row, vector row, score) with score >= the query's threshold."""
        if self.greatest * int(np.abs(queries).max(initial=0)) >= _SAFE:
            return self._wide(queries, threshold)
        a, b = queries * self.low, queries * self.high
        most = np.maximum(a, b)
        order = np.argsort(np.minimum(a, b) - most, axis=1, kind="stable")
        most, q = np.take_along_axis(most, order, 1), np.take_along_axis(queries, order, 1)
        # rest[:, m]: what terms m, m+1, .. can add at most
        rest = np.concatenate([np.cumsum(most[:, ::-1], 1)[:, ::-1], np.zeros((len(queries), 1), most.dtype)], 1)
        n_essential = (rest[:, :-1] > np.maximum((SLACK * threshold).astype(np.int64), 0)[:, None]).sum(1)
        asking = np.flatnonzero(rest[:, 0] >= threshold)
        essential = np.zeros_like(queries)
        np.put_along_axis(essential, order, np.where(np.arange(queries.shape[1]) < n_essential[:, None], q, 0), 1)
        used = np.flatnonzero(essential[asking].any(0))
        partial = essential[np.ix_(asking, used)].astype(self.type) @ self.postings[used]
        bar = np.clip(threshold - np.take_along_axis(rest, n_essential[:, None], 1)[:, 0], -self.exact, self.exact)
        at = np.flatnonzero(partial >= bar[asking, None].astype(self.type))
        row, col = np.divmod(at, max(len(self.ids), 1))
        score, row = partial.ravel()[at].astype(np.int64), asking[row]
        return self._probe(q, order, rest, threshold, n_essential, row, col, score)

    def _probe(self, q, order, rest, threshold, n_essential, row, col, score):
        """Add the non-essential terms of candidates, one at a time, while they are competitive."""
        term, done = n_essential[row], []
        q = q.astype(self.type)
        while True:
            whole = term == q.shape[1]
            done.append((row[whole], col[whole], score[whole]))
            left = ~whole
            row, col, score, term = row[left], col[left], score[left], term[left]
            if not len(row):
                break
            score += (q[row, term] * self.postings[order[row, term], col]).astype(np.int64)
            term += 1
            alive = score + rest[row, term] >= threshold[row]
            row, col, score, term = row[alive], col[alive], score[alive], term[alive]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def _wide(self, queries: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``search``, by integers of any width and for all vectors."""
        score = queries.astype(object) @ self.postings.astype(np.int64).astype(object)
        row, col = np.nonzero(((score >= threshold[:, None]) | (threshold == _NONE)[:, None]).astype(bool))
        found = score[row, col]
        if len(found) and not -(1 << 63) <= found.min() <= found.max() < 1 << 63:
            raise OverflowError("a score has no 64-bit form")
        return row, col, found.astype(np.int64)


class Best:
    """Running k best candidates of each query, as rows (query, score, vec_id, copies)."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, threshold: np.ndarray, k: int):
        self.queries, self.ids, self.k = queries, ids, k
        self.threshold = threshold.copy()
        self.found = [np.zeros((0, 4), np.int64)]
        self.pending = 0

    def add(self, shard: Shard) -> None:
        for at in range(0, len(self.queries), BATCH):
            row, col, score = shard.search(self.queries[at : at + BATCH], self.threshold[at : at + BATCH])
            other = shard.ids[col] != self.ids[at + row]
            got = np.stack([at + row[other], score[other], shard.ids[col[other]], shard.copies[col[other]]], 1)
            self.found.append(got)
            self.pending += len(got)
        if self.pending > 4 * self.k * len(self.queries):
            self.prune()

    def prune(self) -> np.ndarray:
        """Keep the k best of each query and raise the thresholds."""
        all_ = np.concatenate(self.found)
        all_ = all_[np.lexsort((all_[:, 2], ~all_[:, 1], all_[:, 0]))]
        edge = np.searchsorted(all_[:, 0], np.arange(len(self.queries) + 1))
        rank = np.arange(len(all_)) - np.repeat(edge[:-1], np.diff(edge))
        full = np.flatnonzero(np.diff(edge) >= self.k)
        self.threshold[full] = np.maximum(self.threshold[full], all_[edge[full] + self.k - 1, 1])
        kept = all_[rank < self.k]
        self.found, self.pending = [kept], 0
        return kept


def _shards(ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, most: int) -> Iterator[Shard]:
    for at in range(0, len(ids), SHARD):
        part = slice(at, at + SHARD)
        i, v, c = ids[part], vectors[part], copies[part]
        wide = np.abs(v).max(1, initial=0) > (_SAFE - 1) // (most * v.shape[1])
        for rows in (~wide, wide) if wide.any() else (slice(None),):
            if len(i[rows]):
                yield Shard(i[rows], v[rows], most, c[rows])


def first_thresholds(queries: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th score of each query within a sample of rows, where 64 bits are exact."""
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(sample).max(initial=0)) * queries.shape[1]
    out = np.full(len(queries), _NONE)
    if len(sample) < k or bound >= _SAFE:
        return out
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    for at in range(0, len(queries), BATCH):
        part = slice(at, at + BATCH)
        scores = queries[part].astype(kind) @ sample.T.astype(kind)
        own = ids[part, None] == sample_ids
        scores[own] = -bound - 1 if kind is np.int64 else -np.inf
        best = np.partition(scores, -k, axis=1)[:, -k]
        some = (~own).sum(1) >= k
        out[part] = np.where(some, np.where(some, best, 0).astype(np.int64), _NONE)
    return out


def _pivoted(pivots: np.ndarray, width: int):
    """Adds to (vec_id, v, copies) the number of the pivot with the greatest product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = matrix(batch.column(1), width).astype(np.float64) @ pivots.T.astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.argmax(1).astype(np.int32))], names=[*batch.schema.names, "pivot"])

    return run


def _packed(sample_ids: np.ndarray, sample: np.ndarray, k: int):
    """Packs (vec_id, v) queries with the thresholds that the sample gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                ids, q = part.column(0).to_numpy(), matrix(part.column(1), sample.shape[1])
                threshold = first_thresholds(q, ids, sample, sample_ids, k)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, threshold, q)], names=["ids", "thresholds", "queries"])

    return run


def _searched(width: int, most: int, k: int):
    """Streams, block by block, vectors (kind 0) and then packed queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, shards = None, [], None
        for batch in batches:
            names = {n: i for i, n in enumerate(batch.schema.names)}
            blocks, kinds = batch.column(names["block"]).to_numpy(), batch.column(names["kind"]).to_numpy()
            edge = np.flatnonzero(np.r_[True, (np.diff(blocks) != 0) | (np.diff(kinds) != 0), True]) if len(blocks) else []
            for a, b in zip(edge[:-1], edge[1:]):
                if blocks[a] != block:
                    block, parts, shards = blocks[a], [], None
                run_ = batch.slice(a, b - a)
                if not kinds[a]:
                    parts.append((run_.column(names["vec_id"]).to_numpy(), matrix(run_.column(names["v"]), width), run_.column(names["copies"]).to_numpy()))
                    continue
                if shards is None:
                    shards = list(_shards(*(np.concatenate(x) for x in zip(*parts, strict=True)), most)) if parts else []
                for r in range(b - a):
                    ids, threshold, q = (np.frombuffer(run_.column(names[n])[r].as_py(), np.int64) for n in ("ids", "thresholds", "queries"))
                    best = Best(q.reshape(len(ids), width), ids, threshold, k)
                    for shard in shards:
                        best.add(shard)
                    kept = best.prune()
                    yield pa.RecordBatch.from_arrays([pa.array(ids[kept[:, 0]]), *(pa.array(np.ascontiguousarray(kept[:, c])) for c in (1, 2, 3))], names=["query_id", "score", "vec_id", "copies"])

    return run


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query; both inputs are (vec_id, v)."""
    spark = vectors.sparkSession
    asked = materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    shape = asked.agg(F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    width, most = max(int(shape["width"] or 1), 1), max(int(shape["most"] or 1), 1)
    distinct = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).select("vec_id", "v", "copies")
    # at most SAMPLE_CELLS numbers
    rows = vectors.orderBy(F.xxhash64("vec_id", "v")).limit(max(SAMPLE_CELLS // width, 1)).toArrow().combine_chunks()
    sample_ids, sample = rows.column("vec_id").to_numpy(), matrix(rows.column("v").combine_chunks(), width)
    pivots = sample[:PIVOTS] if len(sample) else np.zeros((1, width), np.int64)

    placed = materialize(distinct.mapInArrow(_pivoted(pivots, width), "vec_id long, v array<long>, copies long, pivot int"), "vectors")
    counts = {r["pivot"]: -(-r["n"] // BLOCK) for r in placed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}  # a row for each pivot
    first, n_blocks = {}, 0
    for p in sorted(counts):
        first[p], n_blocks = n_blocks, n_blocks + counts[p]
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    start = F.element_at(F.array(*[F.lit(first.get(p, 0)) for p in range(len(pivots))]), F.col("pivot") + 1)
    width_of = F.element_at(F.array(*[F.lit(max(counts.get(p, 1), 1)) for p in range(len(pivots))]), F.col("pivot") + 1)
    empty = F.lit(None).cast("binary")
    vector_rows = placed.select(
        (start + F.pmod(F.xxhash64("vec_id", "v"), width_of)).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "v", "copies", empty.alias("ids"), empty.alias("thresholds"), empty.alias("queries")
    )
    packs = asked.select("vec_id", "v").mapInArrow(_packed(sample_ids, sample, k), "ids binary, thresholds binary, queries binary")
    query_rows = packs.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<long>").alias("v"), F.lit(None).cast("long").alias("copies"), "ids", "thresholds", "queries"
    )
    dealt = vector_rows.unionByName(query_rows).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block", "kind")
    found = dealt.mapInArrow(_searched(width, most, k), "query_id long, score long, vec_id long, copies long")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
