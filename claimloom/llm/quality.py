"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters of ``WIDTH`` bytes run over the whole
document, each overlapping chunk keeps the maximum of every filter, and the
mean and the maximum over all chunks are combined into one probability.

The network is fitted on the driver on a bounded sample: whole texts of labelled
documents in the order of a hash of their id and text, ``TRAIN_DOCS`` documents
and ``TRAIN_BYTES`` bytes at most. All chunks of these are read, and scoring reads
every byte of every document.
Filters over pairs of bytes are folded into lookup tables, so a filter response
is a sum of three table rows.

Defined cases: a null or empty text is scored as one chunk of padding; without
labels of both classes every document gets the share of label 1 (0.5 without
labels); labels other than 0 and 1 are ignored; equal rows are learned from once
and scored alike; a first text beyond ``TRAIN_BYTES`` is taken as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordhash import text_bytes

WIDTH = 6
FILTERS = 16
EMBED = 8
#: A chunk is four blocks, the next one starts three blocks on.
BLOCK = 64
CHUNK_BLOCKS, STEP_BLOCKS = 4, 3
TRAIN_DOCS = 4000
TRAIN_BYTES = 12_000_000
EPOCHS = 8
_CHUNK = BLOCK * CHUNK_BLOCKS
_PIECE = 1 << 17


class Network:
    """Weights: byte embedding, filters, and the last layer over (mean, max)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.kernel = rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH, EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.bias, self.out, self.out_bias]

    def tables(self) -> np.ndarray:
        """Responses by byte: [WIDTH, 256, FILTERS]."""
        return np.einsum("be,wef->wbf", self.embed, self.kernel)

    def pair_tables(self) -> np.ndarray:
        """Responses by pair of bytes: [WIDTH / 2, 65536, FILTERS]."""
        t = self.tables()
        return np.stack([(t[w][:, None, :] + t[w + 1][None, :, :]).reshape(65536, FILTERS) for w in range(0, WIDTH, 2)])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _peaks(tables: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and value of the greatest response of each filter in each chunk."""
    response = tables[0][x[:, :_CHUNK]]
    for w in range(1, WIDTH):
        response += tables[w][x[:, w : w + _CHUNK]]
    where = response.argmax(1)
    return where, np.take_along_axis(response, where[:, None, :], 1)[:, 0]


def train(chunks: np.ndarray, doc_of: np.ndarray, labels: np.ndarray, *, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit on chunks [n, _CHUNK + WIDTH - 1] of bytes; ``doc_of`` is sorted, labels by document."""
    net = Network(seed)
    rng = np.random.default_rng(seed)
    net.out_bias[0] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    params = net.parameters()
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    first = np.searchsorted(doc_of, np.arange(len(labels) + 1))
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 32):
            docs = order[at : at + 32]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            sizes = first[docs + 1] - first[docs]
            starts = np.cumsum(sizes) - sizes
            x = chunks[rows]
            tables = net.tables()
            where, top = (np.concatenate(y) for y in zip(*(_peaks(tables, x[k : k + 512]) for k in range(0, len(x), 512))))
            top = top + net.bias
            hidden = np.maximum(top, 0)
            mean = np.add.reduceat(hidden, starts) / sizes[:, None]
            most = np.maximum.reduceat(hidden, starts)
            p = _sigmoid(np.concatenate([mean, most], 1) @ net.out + net.out_bias)
            g = ((p - labels[docs]) / len(docs)).astype(np.float32)
            g_feature = g[:, None] * net.out[None]
            owner = np.repeat(np.arange(len(docs)), sizes)
            g_hidden = g_feature[owner, :FILTERS] / sizes[owner][:, None] + g_feature[owner, FILTERS:] * (hidden == most[owner])
            g_top = g_hidden * (top > 0)
            g_tables = np.zeros((WIDTH, 256, FILTERS), np.float32)
            f = np.broadcast_to(np.arange(FILTERS), where.shape)
            for w in range(WIDTH):
                np.add.at(g_tables[w], (np.take_along_axis(x, where + w, 1), f), g_top)
            grads = [
                np.einsum("wbf,wef->be", g_tables, net.kernel),
                np.einsum("wbf,be->wef", g_tables, net.embed),
                g_top.sum(0),
                np.concatenate([mean, most], 1).T @ g + 1e-4 * net.out,
                np.array([g.sum()], np.float32),
            ]
            grads[0][0] = 0
            step += 1
            for k, (q, d) in enumerate(zip(params, grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                q -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    def __init__(self, net: Network):
        self.pairs, self.bias, self.out, self.out_bias = net.pair_tables(), net.bias, net.out, float(net.out_bias[0])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of the documents data[offsets[i]:offsets[i + 1]]."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        blocks = np.maximum(-(-sizes // BLOCK), 1)
        room = blocks * BLOCK + WIDTH - 1
        at = np.cumsum(room) - room
        padded = np.zeros(int(room.sum()), np.uint8)
        padded[np.arange(len(data)) + np.repeat(at - offsets[:-1], sizes)] = data
        first = np.cumsum(blocks) - blocks
        begin = np.repeat(at - first * BLOCK, blocks) + np.arange(int(blocks.sum())) * BLOCK
        peaks = np.empty((len(begin), FILTERS), np.float32)
        step = _PIECE // BLOCK
        for k in range(0, len(begin), step):
            where = (begin[k : k + step, None] + np.arange(BLOCK)).ravel()
            response = None
            for w in range(0, WIDTH, 2):
                pair = padded[where + w].astype(np.int32) << 8 | padded[where + w + 1]
                got = self.pairs[w // 2][pair]
                response = got if response is None else response.__iadd__(got)
            peaks[k : k + step] = response.reshape(-1, BLOCK, FILTERS).max(1)
        chunk_n = np.maximum(-(-(blocks - CHUNK_BLOCKS) // STEP_BLOCKS), 0) + 1
        owner = np.repeat(np.arange(n), chunk_n)
        chunk_first = np.cumsum(chunk_n) - chunk_n
        start = first[owner] + (np.arange(len(owner)) - chunk_first[owner]) * STEP_BLOCKS
        last = first[owner] + blocks[owner] - 1
        top = peaks[start]
        for k in range(1, CHUNK_BLOCKS):
            top = np.maximum(top, peaks[np.minimum(start + k, last)])
        hidden = np.maximum(top + self.bias, 0)
        mean = np.add.reduceat(hidden, chunk_first) / chunk_n[:, None]
        most = np.maximum.reduceat(hidden, chunk_first)
        return _sigmoid(np.concatenate([mean, most], 1) @ self.out + self.out_bias).astype(np.float64)


def _chunks(text: bytes) -> list[bytes]:
    """All overlapping chunks of a text, each with the bytes that its last filter place needs."""
    n = -(-max(len(text) - _CHUNK, 0) // (STEP_BLOCKS * BLOCK)) + 1
    step = STEP_BLOCKS * BLOCK
    return [text[c * step :][: _CHUNK + WIDTH - 1].ljust(_CHUNK + WIDTH - 1, b"\0") for c in range(n)]


def fit(docs: DataFrame, labels: DataFrame, *, limit: int = TRAIN_DOCS, limit_bytes: int = TRAIN_BYTES) -> Network | float:
    """Fit on (doc_id, text) and (doc_id, label); a constant if one class is missing."""
    picked = (
        labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .select("doc_id", F.col("label").cast("int").alias("label"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(limit)
    )
    # at most ``limit`` rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    # many rows may share an id: the sample is bounded once more, before any text moves
    sizes = rows.select("h", "label", F.octet_length("text").alias("n")).distinct().orderBy("h", "label").limit(limit).toArrow()
    within = np.cumsum(sizes.column("n").to_numpy().astype(np.int64)) <= limit_bytes
    if not within.any():
        within[:1] = True
    if not len(within):
        return 0.5
    chosen = docs.sparkSession.createDataFrame(sizes.filter(pa.array(within)).select(["h", "label"]).to_pandas(), "h long, label int")
    got = rows.join(F.broadcast(chosen), ["h", "label"]).groupBy("h", "label").agg(F.min("text").alias("text")).orderBy("h", "label").toArrow()
    label = got.column("label").to_numpy().astype(np.float32)
    if label.min() == label.max():
        return float((label.sum() + 1) / (len(label) + 2))
    parts = [_chunks(t.encode()) for t in got.column("text").to_pylist()]
    chunks = np.frombuffer(b"".join(c for p in parts for c in p), np.uint8).reshape(-1, _CHUNK + WIDTH - 1)
    return train(chunks, np.repeat(np.arange(len(parts)), [len(p) for p in parts]), label)


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """``docs`` with the column ``score``: the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "score"]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    where = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if isinstance(sent.value, float) else Scorer(sent.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = text_bytes(batch.column(where))
            p = np.full(batch.num_rows, sent.value) if scorer is None else scorer(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*keep, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
