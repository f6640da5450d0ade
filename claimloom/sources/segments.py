"""An inverted index on disk: segments of postings in blocks, tombstones, and a search that skips blocks.

A folder holds ``chunks``, ``postings`` and ``gone`` (tombstones), each by
``segment``, and ``_versions`` with one manifest for each committed change. The
postings of a segment lie in folders by a hash of their term. A block holds the
postings of one term among ``BLOCK`` chunks, with the greatest count and the
least length in it; the blocks of a folder's terms among the same chunks are one
row, as most of them hold a single posting. A query reads the folders of its terms alone. What a
block can add to a score at most follows from those two numbers, so blocks of
chunks that can't reach the k best of a query are never looked into, and the
result is exactly that of a search without blocks.

``add`` and ``delete`` write a new segment; an id that comes again replaces its
older chunk. Counts of terms, chunks and lengths are kept for the live chunks
alone (a deleted chunk's terms are counted down), so scores are those of an
index that was built anew. ``compact`` writes the live chunks as one segment.

Defined cases: a null text has no tokens but counts as a chunk; a null id can't
be looked up and is an error; ids given twice in one call are an error; deleting
an unknown id does nothing; an index without chunks finds nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions import text as tx
from ..functions import tokens as tk
from ..operators.retrieval import sized, top_k
from ..storage import releasing, written
from . import versions

#: Chunks whose postings of a term make one block; a place in it takes two bytes.
BLOCK = 1024
#: Folders that terms are dealt to: one for so many chunks, within limits.
CHUNKS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 4096, 8, 512
#: Chunks of which one task writes the blocks of a bucket.
LANE_CHUNKS = 100_000_000
#: Blocks of chunks that are scored first for each query, to know what the others must reach.
FIRST = 2
#: Scores are compared after rounding to six digits.
TIE = 2e-6

#: Blocks of many terms. Places are numbers of two bytes, counts of one byte or, in a block with a greater one, of four.
#: The row of bucket -1 has the ids and lengths of the chunks.
POSTINGS = "shard long, term array<string>, n array<int>, max_tf array<int>, min_dl array<int>, places array<binary>, tfs array<binary>, ids array<string>, dls array<int>"
GONE = "chunk_id string, of int, shard long, place int"
_FOLDERS = "segment int, bucket int"
#: What a block of one term has.
_OF_BLOCK = ("term", "n", "max_tf", "min_dl", "places", "tfs")
#: The form of the files; a folder of another form is not read.
FORM = 2


def bucket_of(term, buckets: int) -> Column:
    return (F.crc32(term) % F.lit(buckets)).cast("int")


def _blocks(block: int, buckets: int):
    """A row for each ``block`` chunks and bucket with the posting blocks of its terms, and one that lists the chunks themselves."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        columns = ["shard", *_OF_BLOCK, "ids", "dls", "bucket"]
        for no, batch in enumerate(tk.slices(batches, block)):
            ids, n = batch.column(0), batch.num_rows
            names, term, doc, tf, length = tk.counted(batch.column(1))
            first = np.flatnonzero(np.diff(term, prepend=-1))
            cuts = np.append(first, len(term))
            most = np.maximum.reduceat(tf, first) if len(first) else np.zeros(0, np.int64)
            if (most > 255).any():
                wide = np.repeat(most > 255, np.diff(cuts))
                # four bytes of each count, of which the first is enough in most blocks
                counts = tf.astype("<u4").view(np.uint8).reshape(-1, 4)
                kept = np.ones(counts.shape, bool)
                kept[:, 1:] = wide[:, None]
                counts, ends = counts[kept], np.concatenate([[0], np.cumsum(np.where(wide, 4, 1))])[cuts]
            else:
                counts, ends = tf.astype(np.uint8), cuts
            binary = lambda at, data: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
            names = names.cast(pa.string()).take(pa.array(term[first]))
            bucket = np.fromiter(map(zlib.crc32, names.cast(pa.binary()).to_pylist()), np.int64, len(first)) % buckets
            order = pa.array(np.argsort(bucket, kind="stable"))
            held, of = np.unique(bucket, return_counts=True)
            bounds = pa.array(np.append(0, np.cumsum(of)).astype(np.int32))
            small = lambda values: pa.array(values.astype(np.int32))
            least = np.minimum.reduceat(length[doc], first) if len(first) else most
            of_block = [names, small(np.diff(cuts)), small(most), small(least), binary(2 * cuts, doc.astype("<u2")), binary(ends, counts)]
            packed = [pa.ListArray.from_arrays(bounds, values.take(order)) for values in of_block]
            none = [pa.nulls(len(held), pa.list_(kind)) for kind in (pa.string(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), (task << 32) + no)), *packed, *none, small(held)], names=columns)
            none = [pa.nulls(1, values.type) for values in packed]
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + no]), *none, pa.array([ids.to_pylist()], pa.list_(pa.string())), pa.array([length.tolist()], pa.list_(pa.int32())), pa.array([-1], pa.int32())], names=columns)

    return run


def _lost(block: int):
    """(bucket, term, n): among how many of the deleted places (dead) a term stands."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                gone = np.zeros(block, np.int64)
                gone[batch.column("dead")[i].values.to_numpy()] = 1
                names, places = batch.column("term")[i].values, batch.column("places")[i].values
                at = np.frombuffer(places.buffers()[1], np.int32)[places.offset : places.offset + len(places) + 1]
                hit = gone[np.frombuffer(places.buffers()[2], np.uint8)[at[0] : at[-1]].copy().view("<u2")]
                n = np.add.reduceat(hit, (at[:-1] - at[0]) // 2)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), batch.column("bucket")[i].as_py()), pa.int32()), names.take(pa.array(some)), pa.array(n[some])], names=["bucket", "term", "n"])

    return run


def _read(spark: SparkSession, path: str, what: str, schema: str, segments: list[dict], folders: str = "segment int") -> DataFrame:
    """A part of the index, of the segments of a manifest alone."""
    own = [s["id"] for s in segments if s[what]]
    full = f"{schema}, {folders}"
    if not own:  # a range needs no Python worker
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(full).fields])
    return spark.read.schema(full).parquet(f"{path}/{what}").where(F.col("segment").isin(own))


def _latest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the folder as it is now."""
    found = versions.latest(spark, path)
    if found and found.get("form") != FORM:
        raise ValueError(f"{path} holds an index of another form; build it again")
    return found


def _rows(spark: SparkSession, path: str, segments: list[dict]) -> DataFrame:
    return _read(spark, path, "postings", POSTINGS, segments, _FOLDERS)


def _postings(spark: SparkSession, path: str, segments: list[dict], columns: tuple[str, ...] = _OF_BLOCK) -> DataFrame:
    """(segment, bucket, shard, ``columns``) of each posting block."""
    return _rows(spark, path, segments).where("bucket >= 0").select("segment", "bucket", "shard", F.inline(F.arrays_zip(*columns)))


def _lists(spark: SparkSession, path: str, segments: list[dict]) -> DataFrame:
    """(segment, shard, ids, dls) of the chunks."""
    return _rows(spark, path, segments).where("bucket = -1").select("segment", "shard", "ids", "dls")


def _stored(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    return _read(spark, path, "chunks", manifest["chunk_schema"], manifest["segments"])


def _gone(spark: SparkSession, path: str, segments: list[dict]) -> DataFrame:
    """(chunk_id, segment, shard, place) of the chunks that were deleted."""
    return _read(spark, path, "gone", GONE, segments).select("chunk_id", F.col("of").alias("segment"), "shard", "place")


def live_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that are in the index now, as they were given."""
    manifest = _latest(spark, path)
    return _live(spark, path, manifest).drop("segment") if manifest else spark.createDataFrame([], "chunk_id string, text string")


def chunks_of_hits(hits: DataFrame, path: str) -> DataFrame:
    """The live chunks with the ids of ``hits`` (chunk_id), once each, written: where the ids are few no other text is shuffled or kept."""
    ids = written(hits.select("chunk_id").distinct(), "hit-ids")
    return written(live_chunks(hits.sparkSession, path).join(sized(ids, ids.count()), "chunk_id", "left_semi"), "hit-chunks")


def _live(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    stored = _stored(spark, path, manifest)
    if not any(x["gone"] for x in manifest["segments"]):
        return stored
    return stored.join(_gone(spark, path, manifest["segments"]).select("chunk_id", "segment"), ["chunk_id", "segment"], "left_anti")


def _change(spark: SparkSession, path: str, chunks: DataFrame | None, gone: DataFrame | None, *, fresh: bool = False, block: int = BLOCK) -> dict:
    """Write one segment and commit it; ``fresh``: it replaces all segments."""
    old = _latest(spark, path)
    known = old or {"segments": [], "chunk_schema": None, "block": block, "buckets": None}
    no = versions.claim_number(spark, f"{path}/_segments")
    entry = {"id": no, "postings": False, "chunks": False, "gone": False, "n": 0, "tokens": 0, "shards": 0}
    schema, buckets = known["chunk_schema"], None if fresh else known["buckets"]
    if chunks is not None:
        schema = schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
        chunks.write.option("compression", "zstd").parquet(f"{path}/chunks/segment={no}")
        own = spark.read.schema(schema).parquet(f"{path}/chunks/segment={no}")
        same = own.groupBy("chunk_id").agg(F.count("*").alias("n"))
        shape = same.agg(F.count_if(F.col("chunk_id").isNull() | (F.col("n") > 1)).alias("bad"), F.count("*").alias("n")).first()
        if shape["bad"]:
            raise ValueError("chunk ids must be given and unique")
        entry["chunks"] = bool(shape["n"])
    if entry["chunks"]:
        buckets = buckets or min(max(shape["n"] // CHUNKS_A_BUCKET, LEAST_BUCKETS), MOST_BUCKETS)
        lanes = 1 + shape["n"] // LANE_CHUNKS
        blocks = own.select("chunk_id", "text").mapInArrow(_blocks(known["block"], buckets), f"{POSTINGS}, bucket int")
        dealt = blocks.repartition("bucket", F.pmod(F.xxhash64("shard"), F.lit(lanes))).sortWithinPartitions("bucket", "shard")
        dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings/segment={no}")
        entry["postings"] = True
        tokens = F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)
        total = _lists(spark, path, [entry]).agg(F.sum(F.size("ids")), F.sum(tokens), F.count("*")).first()
        entry |= {"n": int(total[0]), "tokens": int(total[1]), "shards": int(total[2])}
    if old and not fresh:
        again = [x.select("chunk_id") for x in (gone, own if entry["chunks"] else None) if x is not None]
        ids = again[0] if len(again) == 1 else again[0].unionByName(again[1])
        each = _lists(spark, path, old["segments"]).select("segment", "shard", F.posexplode(F.arrays_zip(F.col("ids").alias("chunk_id"), F.col("dls").alias("dl"))).alias("place", "x"))
        each = each.select("segment", "shard", "place", "x.chunk_id", "x.dl")
        if any(x["gone"] for x in old["segments"]):
            each = each.join(_gone(spark, path, old["segments"]).select("segment", "shard", "place"), ["segment", "shard", "place"], "left_anti")
        dead = written(each.join(ids.distinct(), "chunk_id", "left_semi"), "dead")
        total = dead.agg(F.count("*"), F.sum("dl")).first()
        if total[0]:
            dead.select("chunk_id", F.col("segment").alias("of"), "shard", "place").write.parquet(f"{path}/gone/segment={no}")
            # counts of the terms of deleted chunks, below zero, under folders of the same terms
            places = dead.groupBy("segment", "shard").agg(F.collect_list("place").alias("dead"))  # a block's at most
            blocks = _rows(spark, path, old["segments"]).where("bucket >= 0").select("segment", "shard", "bucket", "term", "places")
            lost = blocks.join(sized(places, int(total[0]) // 16), ["segment", "shard"]).select("bucket", "term", "places", "dead").mapInArrow(_lost(known["block"]), "bucket int, term string, n long")
            minus = lost.groupBy("bucket", "term").agg((-F.sum("n")).cast("int").alias("n"))
            minus.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/lost/segment={no}")
            entry |= {"gone": True, "n": entry["n"] - int(total[0]), "tokens": entry["tokens"] - int(total[1])}
    kept = [] if fresh else known["segments"]
    after = {"segments": [*kept, entry] if entry["chunks"] or entry["gone"] else kept, "chunk_schema": schema, "block": known["block"], "buckets": buckets, "form": FORM}
    return versions.commit(spark, path, old, after)


def build(chunks: DataFrame, path: str, *, block: int = BLOCK) -> dict:
    """A new index over chunks (chunk_id, text, ..) in an empty folder, with ``block`` chunks to a block."""
    spark = chunks.sparkSession
    if _latest(spark, path):
        raise ValueError(f"{path} holds an index already")
    return _change(spark, path, chunks.withColumn("chunk_id", F.col("chunk_id").cast("string")), None, block=block)


def add(chunks: DataFrame, path: str) -> dict:
    """Put chunks in; those with the id of a live chunk replace it."""
    return _change(chunks.sparkSession, path, chunks.withColumn("chunk_id", F.col("chunk_id").cast("string")), None)


def delete(ids: DataFrame, path: str) -> dict:
    """Take chunks (chunk_id) out."""
    return _change(ids.sparkSession, path, None, ids.select(F.col("chunk_id").cast("string").alias("chunk_id")))


def compact(spark: SparkSession, path: str) -> dict:
    """One segment of the live chunks in place of all others, whose files stay until they are swept."""
    return _change(spark, path, live_chunks(spark, path), None, fresh=True)


def statistics(spark: SparkSession, path: str) -> tuple[int, float]:
    """Number of live chunks and their average length in tokens."""
    segments = (_latest(spark, path) or {"segments": []})["segments"]
    n = sum(s["n"] for s in segments)
    return n, sum(s["tokens"] for s in segments) / n if n else 0.0


def _heads(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """(term, segment, shard, n, max_tf, min_dl, bucket) of posting blocks, and counts below zero of deleted chunks without a shard."""
    segments = manifest["segments"]
    heads = _postings(spark, path, segments, ("term", "n", "max_tf", "min_dl")).select("term", "segment", "shard", "n", "max_tf", "min_dl", "bucket")
    down = [s["id"] for s in segments if s["gone"]]
    if down:
        lost = spark.read.schema("term string, n int, segment int, bucket int").parquet(f"{path}/lost").where(F.col("segment").isin(down))
        heads = heads.unionByName(lost, allowMissingColumns=True)
    return heads


def document_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(term, df) over the live chunks."""
    manifest = _latest(spark, path) or {"segments": []}
    return _frequencies(_heads(spark, path, manifest))


def _frequencies(heads: DataFrame) -> DataFrame:
    return heads.groupBy("term").agg(F.sum("n").cast("long").alias("df")).where("df > 0")


def _of_terms(rows: DataFrame, terms: DataFrame, buckets: list[int], n: int) -> DataFrame:
    """Rows of at most ``n`` asked terms: their folders are named in the plan, so no other is read."""
    return rows.where(F.col("bucket").isin(buckets)).join(sized(terms.select("term").distinct(), n), "term", "left_semi")


def _scored(k: int, average: float):
    """For each block of chunks the ``k`` best of each query, by a product of weights and counts.

    Rows come by (segment, shard): deleted places (kind 0), postings (1), queries (2), the ids and lengths of the chunks (3).
    """
    k1, b = config.BM25_K1, config.BM25_B

    def cells(column: pa.Array, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The values of some rows of a column of lists, one after the other, and how many each has."""
        some = column.take(pa.array(at, pa.int64()))
        return some.flatten().to_numpy(zero_copy_only=False), np.diff(some.offsets.to_numpy())

    def raw(column: pa.Array, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some rows of a binary column, and how many each has."""
        some = column.take(pa.array(at, pa.int64()))
        offsets = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]
        return np.frombuffer(some.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy(), np.diff(offsets)

    def best(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kind = rows.column("kind").to_numpy()
        posts, asked = np.flatnonzero(kind == 1).tolist(), np.flatnonzero(kind == 2).tolist()
        if not posts or not asked:
            return
        dead, _ = cells(rows.column("dead"), np.flatnonzero(kind == 0).tolist())
        place, count = raw(rows.column("places"), posts)
        place, count = place.view("<u2").astype(np.int64), count // 2
        packed, width = raw(rows.column("tfs"), posts)
        wide = np.repeat(width != count, count)
        tf = np.zeros(len(place))
        tf[~wide] = packed[np.repeat(width == count, width)]
        tf[wide] = packed[np.repeat(width != count, width)].view("<u4")
        listed = int(np.flatnonzero(kind == 3)[0])
        dl = rows.column("dls")[listed].values.to_numpy().astype(float)[place]
        size = int(place.max()) + 1
        part = np.zeros((len(posts), size))
        part[np.repeat(np.arange(len(posts)), count), place] = tf / (tf + k1 * (1 - b + b * dl / average))
        row_of = {t: i for i, t in enumerate(rows.column("term").take(pa.array(posts, pa.int64())).to_pylist())}
        for at in range(0, len(asked), 256):
            pack = asked[at : at + 256]
            terms, held = cells(rows.column("terms"), pack)
            found = np.array([row_of.get(t, -1) for t in terms.tolist()], np.int64)
            weight = np.zeros((len(pack), len(posts)))
            weight[np.repeat(np.arange(len(pack)), held)[found >= 0], found[found >= 0]] = cells(rows.column("weights"), pack)[0][found >= 0]
            score = weight @ part
            score[:, dead[dead < size].astype(np.int64)] = 0.0
            bar = np.partition(score, -k, axis=1)[:, -k] - TIE if size > k else np.zeros(len(pack))
            # what may tie with the last one after rounding stays
            q, place_of = np.nonzero((score >= bar[:, None]) & (score > 0))
            no = rows.column("no").take(pa.array(pack, pa.int64())).to_numpy()[q]
            yield pa.RecordBatch.from_arrays([pa.array(no), rows.column("ids")[listed].values.take(pa.array(place_of)), pa.array(score[q, place_of])], names=["no", "chunk_id", "score"])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one block of chunks
        for batch in batches:
            segment, shard = batch.column("segment").to_numpy(), batch.column("shard").to_numpy()
            cuts = np.flatnonzero((np.diff(segment) != 0) | (np.diff(shard) != 0)) + 1
            if held and batch.num_rows and (held[0].column("segment")[0].as_py(), held[0].column("shard")[0].as_py()) != (int(segment[0]), int(shard[0])):
                yield from best(pa.concat_batches(held))
                held = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if lo:
                    yield from best(pa.concat_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from best(pa.concat_batches(held))

    return run


def _open(bounds: DataFrame, seen: DataFrame, bar: DataFrame) -> DataFrame:
    """Blocks of chunks that are not seen yet and can reach the bar of their query."""
    left = bounds.join(seen, ["no", "segment", "shard"], "left_anti").join(bar, "no", "left")
    return left.where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - TIE))


def search(queries: DataFrame, path: str, *, k: int = config.SPARSE_K, query: str = "query_id", digits: int = 6) -> DataFrame:
    """(query, chunk_id, score, rank): the k best chunks of each query (query, text) by BM25.

    The heads of the asked blocks give a bound for each query and block of
    chunks. The ``FIRST`` best of a query's are scored; of the others those
    that can still reach its k-th score.
    """
    spark = queries.sparkSession
    manifest = _latest(spark, path) or {"segments": [], "buckets": 1}
    asked = queries.select(query, F.explode(tx.search_tokens("text")).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qtf"))
    asked = written(asked.groupBy(query).agg(F.collect_list(F.struct("term", "qtf")).alias("terms")).withColumn("no", F.monotonically_increasing_id()), "asked")  # the terms of one query
    each = asked.select("no", F.inline("terms"))
    shape = each.agg(F.collect_set(bucket_of("term", manifest["buckets"] or 1)).alias("buckets"), F.count("*").alias("n")).first()  # MOST_BUCKETS numbers at most
    heads = written(_of_terms(_heads(spark, path, manifest), each, shape["buckets"], shape["n"]).drop("bucket"), "heads")
    n, average = statistics(spark, path)
    df, k1, b = F.col("df"), F.lit(config.BM25_K1), F.lit(config.BM25_B)
    idf = _frequencies(heads).select("term", F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5)).alias("idf"))
    weighted = written(each.join(idf, "term").select("no", "term", (F.col("qtf") * F.col("idf") * (config.BM25_K1 + 1)).alias("weight")), "weights")
    most = F.col("weight") * F.col("max_tf") / (F.col("max_tf") + k1 * (1 - b + b * F.col("min_dl") / F.lit(average or 1.0)))
    bounds = heads.where("shard IS NOT NULL").join(sized(weighted, shape["n"]), "term").groupBy("no", "segment", "shard").agg(F.sum(most).alias("bound"))
    bounds = written(bounds, "bounds")
    packs = weighted.groupBy("no").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    posts = _of_terms(_postings(spark, path, manifest["segments"], ("term", "places", "tfs")), weighted, shape["buckets"], shape["n"]).select("segment", "shard", F.lit(1).alias("kind"), "term", "places", "tfs")
    # a number of parts that small data is not packed into fewer ones
    shards = sum(x["shards"] for x in manifest["segments"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dead = _gone(spark, path, manifest["segments"]).groupBy("segment", "shard").agg(F.collect_list("place").alias("dead")).withColumn("kind", F.lit(0))
    lists = _lists(spark, path, manifest["segments"]).withColumn("kind", F.lit(3))

    def best(chosen: DataFrame) -> DataFrame:
        wanted = chosen.select("no", "segment", "shard").join(packs, "no").withColumn("kind", F.lit(2))
        here = sized(chosen.select("segment", "shard").distinct(), shards)
        rows = posts.unionByName(lists, allowMissingColumns=True).unionByName(dead, allowMissingColumns=True).join(here, ["segment", "shard"], "left_semi").unionByName(wanted, allowMissingColumns=True)
        # no null lists: Arrow's writer fills the offsets of all of a batch's anew at each row
        full = [F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in ("dead", "ids", "dls", "terms", "weights")]
        rows = rows.select("segment", "shard", "kind", "term", "places", "tfs", "no", *full).repartition(parts, "segment", "shard").sortWithinPartitions("segment", "shard")
        found = rows.mapInArrow(_scored(k, average or 1.0), "no long, chunk_id string, score double")
        return found.withColumn("score", F.round("score", digits)).where("score > 0")

    seen = written(top_k(bounds, "no", FIRST, F.desc("bound"), "segment", "shard").select("no", "segment", "shard"), "best-bounds")
    first = written(best(seen), "first-hits")
    bar = top_k(first, "no", k, F.desc("score"), F.asc("chunk_id")).where(F.col("rank") == k).select("no", F.col("score").alias("bar"))
    both = first.unionByName(best(_open(bounds, seen, bar)))
    return top_k(both, "no", k, F.desc("score"), F.asc("chunk_id")).join(sized(asked.select("no", query), shape["n"]), "no").select(query, "chunk_id", "score", "rank")
