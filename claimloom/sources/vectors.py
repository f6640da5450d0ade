"""Inverted lists of vectors on disk: approximate cosine search that looks into the lists nearest to a query.

``build`` trains centroids on a bounded sample (``SAMPLE`` vectors), gives every
vector to its nearest centroid and writes the lists by folder. A list with more
than ``LIST_ROWS`` vectors, such as one of many copies, is split into blocks. A
query is sent to all blocks of the lists whose centroids are nearest to it, as
many as hold at least a stated share of all lists, and each block gives its best
by one matrix product, as in the exact search. With all lists the result is that
of ``retrieval.dense_topk``.

Defined cases: vectors that are null, empty or hold a null or no finite number
take no part; shorter ones count as if filled up with zeros, and queries that
are longer than the index's vectors are cut to its width, where their other
numbers would meet zeros, after they were normalised; a zero vector has score 0
with all; equal scores go by vec_id; an empty index finds nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators.retrieval import best_of_block, normalized, top_k
from . import versions

#: Vectors that centroids are trained on, lists that an index has at most, and rounds of training.
SAMPLE, MOST_LISTS, ROUNDS = 65_536, 4096, 10
#: Vectors of one block of a list, and folders that lists are dealt to.
LIST_ROWS, FOLDERS = 8192, 64
#: Share of the lists that a query looks into. On vectors without clusters, as the given ones, 0.8 finds over 0.9 of the exact rows.
PROBED = 0.8


def _sound(column: str):
    return (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def _units(vectors: DataFrame, width: int) -> DataFrame:
    """(vec_id, u): unit vectors of one width."""
    filled = F.slice(F.concat(normalized("embedding"), F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size("embedding"), F.lit(0)))), 1, width)
    return vectors.where(_sound("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), filled.alias("u"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def trained(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of unit length by Lloyd's rounds; a centroid without vectors stays where it is."""
    rng = np.random.default_rng(0)
    at = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(sample[i : i + 8192] @ at.T).argmax(1) for i in range(0, len(sample), 8192)])
        sums = np.zeros_like(at)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1)
        at[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return at


def build(vectors: DataFrame, path: str, *, lists: int | None = None) -> dict:
    """Write an index of (vec_id, embedding) under ``path``; by default about as many lists as a list has vectors."""
    spark = vectors.sparkSession
    shape = vectors.where(_sound("embedding")).agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    n, width = int(shape["n"]), int(shape["width"] or 1)
    rows = _units(vectors, width)
    if not n:
        return versions.commit(spark, path, None, {"n": 0, "width": width, "lists": 0, "blocks": []})
    chosen = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE).select("u").toArrow().column("u")  # a bounded sample
    sample = _matrix(chosen.combine_chunks(), width)
    centroids = trained(sample, min(lists or max(1, round(n**0.5)), MOST_LISTS, len(sample)))
    sent = spark.sparkContext.broadcast(centroids)  # MOST_LISTS vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.concatenate([(_matrix(part, width) @ sent.value.T).argmax(1) for part in (batch.column(1).slice(i, 4096) for i in range(0, batch.num_rows, 4096))] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["vec_id", "u", "list"])

    given = rows.mapInArrow(assign, "vec_id long, u array<double>, list int")
    counts = {r["list"]: r["n"] for r in given.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MOST_LISTS rows at most
    blocks = [-(-counts.get(i, 0) // LIST_ROWS) for i in range(len(centroids))]
    of = F.get(F.array(*[F.lit(max(b, 1)) for b in blocks]), F.col("list"))
    dealt = given.withColumns({"part": F.pmod(F.xxhash64("vec_id"), of).cast("int"), "folder": F.col("list") % FOLDERS})
    dealt.repartition("list", "part").sortWithinPartitions("folder", "list", "part").write.option("compression", "zstd").partitionBy("folder").parquet(f"{path}/lists")
    table = spark.createDataFrame([(json.dumps(centroids.tolist()),)], "centroids string")
    table.coalesce(1).write.text(f"{path}/centroids")
    return versions.commit(spark, path, None, {"n": n, "width": width, "lists": len(centroids), "blocks": blocks})


def search(queries: DataFrame, path: str, *, k: int = config.DENSE_K, probed: float = PROBED, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest other vectors of each query (vec_id, embedding) among the probed lists."""
    spark: SparkSession = queries.sparkSession
    manifest = versions.latest(spark, path)
    if manifest is None:
        raise ValueError(f"no index under {path}")
    width, lists = manifest["width"], manifest["lists"]
    if not lists:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank long")
    centroids = np.array(json.loads(spark.read.text(f"{path}/centroids").first()[0]))
    sent = spark.sparkContext.broadcast((centroids, np.array(manifest["blocks"])))
    probes = min(lists, max(1, -(-int(1e6 * probed) * lists // 1_000_000)))
    # lists are told apart by whole numbers, their blocks by the numbers between
    room = max(manifest["blocks"]) + 1

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks = sent.value
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                score = _matrix(batch.column(1), width) @ at.T
                near = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
                q, one = np.repeat(np.arange(batch.num_rows), probes), near.ravel()
                parts = blocks[one]
                q, one = np.repeat(q, parts), np.repeat(one, parts)
                part = np.arange(len(one)) - np.repeat(np.cumsum(parts) - parts, parts)
                order = np.argsort(one * room + part, kind="stable")
                q, block = q[order], (one * room + part)[order]
                first = np.flatnonzero(np.diff(block, prepend=-1))
                # the queries of a block leave as one pack
                cuts = np.append(first, len(q)).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(cuts), batch.column(0).take(pa.array(q)))
                values = pa.ListArray.from_arrays(pa.array(cuts * width), pa.array(_matrix(batch.column(1), width)[q].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(np.ones(len(first), np.int32)), ids, values], names=["block", "kind", "ids", "values"])

    asked = _units(queries, width).mapInArrow(probe, "block long, kind int, ids array<long>, values array<double>")
    stored = spark.read.schema("vec_id long, u array<double>, list int, part int, folder int").parquet(f"{path}/lists")
    block = (F.col("list").cast("long") * room + F.col("part")).alias("block")
    held = stored.select(block, F.lit(0).alias("kind"), F.array("vec_id").alias("ids"), F.col("u").alias("values"))
    both = held.unionByName(asked).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block", "kind")
    scored = both.mapInArrow(best_of_block(width, k), "query_id long, vec_id long, score double").withColumn("score", F.round("score", digits))
    return top_k(scored, "query_id", k, F.desc("score"), F.asc("vec_id"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, vec_id) that were found."""
    total = exact.count()
    return exact.join(found.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi").count() / total if total else 1.0
