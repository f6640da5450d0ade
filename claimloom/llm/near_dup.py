"""Near duplicates by b-bit MinHash.

Texts become sets of word shingles; documents with the same set are one class.
A class keeps ``HASHES`` minima: bands of ``ROWS`` of them give candidates, and
their low ``BITS`` bits, packed, estimate the similarity of a candidate pair by
bit counts, corrected for chance collisions. Candidates whose estimate is not
far below the threshold are confirmed on the full sets.

A bucket never yields all of its pairs. In each of ``ROUNDS`` rounds a document
meets one other at most: of the buckets that still hold several components, each
names the member that is least in the order of the round, and of these a
document takes the least. Confirmed links give components. Buckets that still
hold several components after that are searched on in blocks of bounded size:
what leaves a block is not pairs but a spanning forest of those the estimate
lets pass, so at most a row for each member. Documents that these forests join
are a cluster; in each cluster, again in blocks, documents of different
components are compared on their full sets unless links of the block have joined
them before, and a forest of links comes out. Every pair that shares a band is thus linked, already connected, or
refused by the estimate (six standard deviations below the threshold) or by the
full sets. A pair at similarity 0.8 shares no band with probability
(1 - 0.8**ROWS)**BANDS = 4e-8.

Defined cases: a text with fewer words than a shingle is one shingle, its whole
sequence; a null or empty text has the empty set and is linked with nothing;
rows with equal ids and different texts are different documents that carry the
same id; a null id never is the least of a group that has another.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import materialize, releasing
from .wordhash import Rolling, Words, by_bytes, mix, seeded, split_words

ROWS, BANDS, BITS = 6, 56, 4
HASHES = ROWS * BANDS
#: Rounds in which a document meets one hub before buckets are searched in full.
ROUNDS = 2
#: Bucket members compared with each other in one task at most.
BLOCK = 1024
#: Compressed text of a block on average; a text beyond it is a block with what falls to it.
BLOCK_BYTES = 4_000_000

_SHINGLES = Rolling(0x51A6)
_MUL = (seeded(HASHES, 1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (seeded(HASHES, 2) >> np.uint64(32)).astype(np.uint32)
_BAND = seeded(HASHES, 3).reshape(BANDS, ROWS) | np.uint64(1)
_BAND_NO = seeded(BANDS, 4)


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every document."""
    prefix = _SHINGLES.prefix(w.hashes)
    starts = np.arange(max(len(w.hashes) - size + 1, 0))
    grams = _SHINGLES.slices(prefix, starts, starts + size)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(_SHINGLES.slices(prefix, np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(s: np.ndarray) -> int:
    """A 64-bit hash of a set, signed."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        out = np.minimum(out, (_MUL[:, None] * x[None, at : at + 1024] + _ADD[:, None]).min(1))
    return out


def pack(low: np.ndarray) -> bytes:
    """Low BITS bits of the minima, two to a byte."""
    nibbles = (low & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return (nibbles[0::2] | nibbles[1::2] << 4).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures [.., HASHES / 16] (uint64), corrected for chance."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1)
    chance = 1 / (1 << BITS)
    return (1 - differ / HASHES - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """Six standard deviations of the estimate below the threshold."""
    chance = 1 / (1 << BITS)
    match = threshold + (1 - threshold) * chance
    return threshold - 6 * float(np.sqrt(match * (1 - match) / HASHES)) / (1 - chance)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signatures(size: int):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", 2_000_000):
                counts, nodes, signs, bands = [], [], [], []
                for s in shingle_sets(split_words(batch.column(2), lower=True), size):
                    counts.append(len(s))
                    if not len(s):
                        nodes.append(None)
                        signs.append(None)
                        bands.append([])
                        continue
                    m = minima(s)
                    nodes.append(set_hash(s))
                    signs.append(pack(m))
                    with np.errstate(over="ignore"):
                        bands.append(mix((m.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(1, dtype=np.uint64) + _BAND_NO).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "mark", "n_shingles", "node", "sign", "bands"],
                )

    return run


def _texts(size: int):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for batch in by_bytes(whole, "text", 2_000_000):
                sets = shingle_sets(split_words(batch.column(1), lower=True), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()),
                        batch.column(0),
                        pa.array([press((t or "").encode()) if len(s) else None for s, t in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.binary()),
                    ],
                    names=["node", "doc_id", "packed"],
                )

    return run


def _confirm(size: int, percent: int):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def shingles(node: int, packed: bytes) -> np.ndarray:
            if node not in recent:
                recent[node] = shingle_sets(split_words(pa.array([unpress(packed)]).cast(pa.string()), lower=True), size)[0]
                if len(recent) > 32:
                    recent.popitem(last=False)
            return recent[node]

        for batch in batches:
            a, b, of_a, of_b = batch.columns
            good = [similar(shingles(x, p), shingles(y, q), percent) for x, y, p, q in zip(a.to_pylist(), b.to_pylist(), of_a.to_pylist(), of_b.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _estimates(least: float):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in batch.columns[2:4])
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(estimate(a, b) >= least))

    return run


class _Forest:
    """Union-find over small numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _block(m, least: float, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, estimates) of pairs of one block pair that belong to different components."""
    root, size, side = (m.field(f).to_numpy() for f in ("root", "n", "side"))
    sign = np.frombuffer(b"".join(m.field("sign").to_pylist()), np.uint64).reshape(len(m), -1)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for at in range(0, len(left), 64):
        row = left[at : at + 64]
        good = root[row][:, None] != root[right][None]
        good &= 100 * np.minimum(size[row][:, None], size[right]) >= percent * np.maximum(size[row][:, None], size[right])
        x, y = np.nonzero(good)
        x, y = row[x], right[y]
        near = estimate(sign[x], sign[y])
        close = near >= least
        yield x[close], y[close], near[close]


def _numbered(m) -> tuple[np.ndarray, list[int], _Forest]:
    """Nodes of a block, their components as small numbers, and a forest over those."""
    _, number = np.unique(m.field("root").to_numpy(), return_inverse=True)
    return m.field("node").to_numpy(), number.tolist(), _Forest(int(number.max(initial=-1)) + 1)


def _weak(least: float, percent: int):
    """A spanning forest over the components of a block pair, by estimates alone."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for members in batch.column(0):
                node, of, forest = _numbered(members.values)
                for x, y, _ in _block(members.values, least, percent):
                    links += [(int(node[i]), int(node[j])) for i, j in zip(x.tolist(), y.tolist(), strict=True) if forest.join(of[i], of[j])]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _settle(size: int, percent: int, least: float):
    """A forest of confirmed links over the components of a block pair of a cluster."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            links = []
            for members in batch.column(0):
                m = members.values
                node, of, forest = _numbered(m)
                packed = m.field("packed")
                known: dict[int, np.ndarray] = {}

                def shingles(i: int) -> np.ndarray:
                    if i not in known:
                        known[i] = shingle_sets(split_words(pa.array([unpress(packed[i].as_py())]).cast(pa.string()), lower=True), size)[0]
                    return known[i]

                for x, y, near in _block(m, least, percent):
                    order = np.argsort(-near, kind="stable")
                    for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
                        if forest.find(of[i]) != forest.find(of[j]) and similar(shingles(i), shingles(j), percent):
                            forest.join(of[i], of[j])
                            links.append((int(node[i]), int(node[j])))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def groups(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of (doc_id, text): doc_id, mark (hash of the text), n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(_signatures(size), f"doc_id {id_type}, mark long, n_shingles long, node long, sign binary, bands array<long>"), "signatures")
    least = least_estimate(percent / 100)

    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    members = rows.where("node is not null").select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
    shared = materialize(members.join(buckets, "bucket").select("bucket", "node").distinct(), "buckets")

    signs = rows.where("node is not null").groupBy("node").agg(F.min("sign").alias("sign"), F.first("n_shingles").alias("n"))
    involved = shared.select("node").distinct()
    known = materialize(signs.join(involved, "node"), "signs")
    texts = docs.mapInArrow(_texts(size), f"node long, doc_id {id_type}, packed binary").where("node is not null")
    wanted = classes.join(involved, "node").select("node", "doc_id")
    texts = materialize(
        texts.alias("t").join(wanted.alias("w"), (F.col("t.node") == F.col("w.node")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))).select("t.node", "t.packed"), "texts"
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("packed").alias("of_a"))
        right = texts.select(F.col("node").alias("b"), F.col("packed").alias("of_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
        return materialize(both.mapInArrow(_confirm(size, percent), "a long, b long"), "links")

    def near(pairs: DataFrame) -> DataFrame:
        a = known.select(F.col("node").alias("a"), F.col("sign").alias("sign_a"), F.col("n").alias("n_a"))
        b = known.select(F.col("node").alias("b"), F.col("sign").alias("sign_b"), F.col("n").alias("n_b"))
        sized = pairs.join(a, "a").join(b, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        return sized.select("a", "b", "sign_a", "sign_b").mapInArrow(_estimates(least), "a long, b long")

    links, placed = None, shared.withColumn("root", F.col("node"))
    for no in range(ROUNDS):
        hubs = (
            placed.groupBy("bucket")
            .agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(F.xxhash64("node", F.lit(no)).alias("at"), "node", "root")).alias("hub"))
            .where("lo < hi")
            .select("bucket", "hub")
        )
        met = placed.join(hubs, "bucket").where("root <> hub.root").groupBy("node").agg(F.min("hub").alias("hub"))
        got = confirmed(near(met.select(F.col("hub.node").alias("a"), F.col("node").alias("b"))))
        links = got if links is None else links.unionByName(got)
        roots = components(links)
        placed = materialize(shared.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "placed")

    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("bucket", F.ceil(F.col("c") / BLOCK).cast("int").alias("n_blocks"))
    def in_blocks(rows: DataFrame, group: str, *columns: str) -> DataFrame:
        """Rows (group, n_blocks, ..) dealt to all pairs of blocks of their group: (members)."""
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
        pairs = dealt.select(group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.struct("node", "root", "n", side.alias("side"), "sign", *columns).alias("m"))
        return pairs.groupBy(group, "i", "j").agg(F.collect_list("m").alias("members")).select("members")  # two blocks

    weak = in_blocks(placed.join(mixed, "bucket").join(known, "node"), "bucket").mapInArrow(_weak(least, percent), "a long, b long").distinct()
    clusters = components(weak).withColumnRenamed("root", "cluster")
    # a component that a cluster touches takes part as a whole
    nodes = placed.select("node", "root").distinct()
    touched = clusters.join(nodes, "node").select("cluster", "root").distinct()
    inside = components(touched.groupBy("root").agg(F.min("cluster").alias("least")).join(touched, "root").select(F.col("least").alias("a"), F.col("cluster").alias("b")))
    cluster_of = touched.groupBy("root").agg(F.min("cluster").alias("c")).join(inside.select(F.col("node").alias("c"), F.col("root").alias("whole")), "c", "left").select("root", F.coalesce("whole", "c").alias("cluster"))
    taking_part = nodes.join(cluster_of, "root").select("node", "root", "cluster")
    with_text = taking_part.join(texts, "node")
    blocks = with_text.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.length("packed")) / BLOCK_BYTES)).cast("int").alias("n_blocks"))
    full = with_text.join(blocks, "cluster").join(known, "node")
    more = in_blocks(full, "cluster", "packed").mapInArrow(_settle(size, percent, least), "a long, b long")
    more = materialize(more, "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    by_root = classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "doc_id")
    least_id = by_root.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = by_root.select("node", "root").join(least_id, "root").select("node", "component_id")
    return (
        rows.select("doc_id", "mark", "n_shingles", "node")
        .join(of_node, "node", "left")
        .select("doc_id", "mark", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
