"""Token-ID files with Elias-Fano document boundaries.

A token set is a Parquet folder whose rows are binary blocks in document
order; one block holds the ids of some thousand documents back to back:

    magic "EFT2" | id width (2 or 4) | low bits l | documents n | ids u
    select directory | low part of the n end offsets, l bits each
    high part as a unary bit set | ids

The end offset of document i is ``(select1(high, i) - i) << l | low[i]``; the
parts take 2 + log2(u / n) bits a document, and an eighth of a bit for the
directory, which holds the place of every 256th set bit. No table of 64-bit
offsets is kept or built: a reader takes 256 documents at a time. Blocks also carry their part number, their order in the part and the ids
before them in that part, so a global offset is a sum of per-part totals (one
row for each part) and a select.

Defined cases: a null text is an empty one and yields the end id alone; rows
that share a doc_id stay separate documents, ordered by the hash of their
text; rows without a doc_id come first; an empty table yields no block.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import releasing

END_ID = 0
BLOCK_DOCS = 4096
BLOCK_IDS = 4_000_000
_HEAD = struct.Struct("<4sBBIQ")
_MAGIC = b"EFT2"
#: Documents for each entry of a select directory.
SAMPLE = 256
#: Entries of the memo of spellings to ids that a worker keeps.
MEMO = 1_500_000


class EliasFano:
    """A non-decreasing sequence of n integers up to u, in near-minimal space.

    ``samples`` is the select directory: the place of every ``SAMPLE``-th set bit
    of the high part. A look-up reads the bits between two samples alone.
    """

    def __init__(self, low_bits: int, n: int, low: bytes, high: bytes, samples: np.ndarray):
        self.low_bits, self.n, self.low, self.high, self.samples = low_bits, n, low, high, samples

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        values = values.astype(np.uint64)
        high = np.zeros((top >> bits) + n + 1, np.uint8)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high[places] = 1
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        return EliasFano(bits, n, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4"))

    def values(self, first: int, count: int) -> np.ndarray:
        """Values first to first + count - 1: ``select1`` in the high part, then the low bits."""
        if count <= 0:
            return np.zeros(0, np.int64)
        begin = int(self.samples[first // SAMPLE])
        after = (first + count - 1) // SAMPLE + 1
        stop = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        window = np.frombuffer(self.high, np.uint8)[begin >> 3 : (stop + 7) >> 3]
        ones = np.flatnonzero(np.unpackbits(window, bitorder="little")) + (begin >> 3 << 3)
        ones = ones[np.searchsorted(ones, begin) + first % SAMPLE :][:count]
        out = (ones - np.arange(first, first + count)) << self.low_bits
        if self.low_bits:
            bit = first * self.low_bits
            raw = np.unpackbits(np.frombuffer(self.low, np.uint8)[bit >> 3 : (bit + count * self.low_bits + 7) >> 3], bitorder="little")
            out |= raw[bit & 7 :][: count * self.low_bits].reshape(count, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out

    def select(self) -> np.ndarray:
        """All values."""
        return self.values(0, self.n)

    def at(self, i: int) -> int:
        """One value."""
        return int(self.values(i, 1)[0])


def pack_block(ids: np.ndarray, ends: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    ef = EliasFano.encode(ends)
    head = _HEAD.pack(_MAGIC, width, ef.low_bits, ef.n, len(ids))
    return b"".join([head, ef.samples.tobytes(), ef.low, ef.high, ids.astype("<u2" if width == 2 else "<u4").tobytes()])


def unpack_block(block: bytes) -> tuple[np.ndarray, EliasFano]:
    magic, width, bits, n, total = _HEAD.unpack_from(block)
    if magic != _MAGIC:
        raise ValueError("not a token block")
    at = _HEAD.size
    samples = np.frombuffer(block, "<u4", -(-n // SAMPLE), at)
    at += samples.nbytes
    low = block[at : (at := at + (n * bits + 7) // 8)]
    ids_at = len(block) - total * width
    return np.frombuffer(block, "<u2" if width == 2 else "<u4", total, ids_at), EliasFano(bits, n, low, block[at:ids_at], samples)


#: Marks that never share a token of the pre-tokenizer with a letter before them.
_MARKS = ".,;:!?|&*#$%()[]"
#: Letters on which all versions of the character tables agree.
_LETTERS = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: White space beside a space: such texts are cut with care.
_WIDE = re.compile(r" \s|\s |^ | $")


def _gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ids[start[w] : start[w] + size[w]] of all w in which, back to back."""
    n = size[which]
    ends = np.cumsum(n)
    return ids[np.repeat(start[which] - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)]


class _Numbers(dict):
    """Numbers spellings in the order they are first asked for."""

    def __init__(self, take):
        self._take = take

    def __missing__(self, key: str) -> int:
        self[key] = number = self._take(key)
        return number


class Encoder:
    """Text to ids with a byte-level tokenizer of the tokenizers library.

    Its pre-tokenizer always starts a new token at a lone space between two
    characters that are not white space, so a text is the concatenation of its
    space-led pieces, and each distinct piece is encoded once. The ids of all
    known pieces lie in one array; a text is a gather of its pieces.

    With ``added`` the tokenizer's added tokens are found in the text, as its
    plain ``encode`` does; else they are spelled out as other text is.
    """

    def __init__(self, path: str, *, added: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not added
        tokens = [t for t in self._tokenizer.get_added_tokens_decoder().values() if t.content and (added or not t.special)]
        #: Added tokens lie in one piece, but for those that hold white space or look beyond themselves.
        wide = [t for t in tokens if re.search(r"\s", t.content) or t.lstrip or t.rstrip or t.single_word]
        self._added, self._apart = self._any_of(tokens), self._any_of(wide)
        feed = self._tokenizer.encode("\n", add_special_tokens=False).ids
        self._feed = feed[0] if len(feed) == 1 else -1
        self._forget()

    @staticmethod
    def _any_of(tokens: list) -> re.Pattern | None:
        return re.compile("|".join(re.escape(t.content) for t in tokens)) if tokens else None

    def _forget(self) -> None:
        #: Piece number by spelling: of pieces as they are, and of those after a space.
        self._bare, self._led = _Numbers(self._take_bare), _Numbers(self._take_led)
        self._new: list[str] = []
        self._known = 0
        self._start, self._length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    @staticmethod
    def _wide(text: str) -> bool:
        """Whether white space stands beside a space, or a space at an end."""
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return True
        if "\n" not in text and text.isprintable():
            return False
        # all white space but the space is not printable; line feeds are the common case
        return " \n" in text or "\n " in text or (not text.replace("\n", "").isprintable() and _WIDE.search(text) is not None)

    def _take_bare(self, piece: str) -> int:
        self._new.append(piece)
        return self._known + len(self._new) - 1

    def _take_led(self, piece: str) -> int:
        self._new.append(f" {piece}")
        return self._known + len(self._new) - 1

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The pieces of any text; all but the first start with a space."""
        parts = text.split(" ")
        out = [parts[0]]
        blank = parts[0] == "" or parts[0][-1].isspace()
        for part in parts[1:]:
            if blank or not part or part[0].isspace():
                out[-1] = f"{out[-1]} {part}"
            else:
                out.append(f" {part}")
            blank = not part or part[-1].isspace()
        return out

    def _some(self, pieces: list[str]) -> tuple[bool, bool]:
        """Whether any piece is empty or holds a line feed, and whether any may hold an added token."""
        joined = "\n".join(pieces)
        return joined.count("\n") >= len(pieces) or "\n\n" in joined or not (pieces[0] and pieces[-1]), self._added is not None and self._added.search(joined) is not None

    def _spell(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in some order, and where each piece's ids start and how many they are."""
        odd: list[int] = []
        plain: list[int] | range = range(len(pieces))
        odd_ones, added = self._some(pieces) if pieces else (False, False)
        if odd_ones or added:
            alone = [not p or "\n" in p or (added and self._added.search(p) is not None) for p in pieces]
            plain = [i for i, a in enumerate(alone) if not a]
            odd = [i for i, a in enumerate(alone) if a]
        order, sizes, ids = [], [], []
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            # a line feed between the pieces is a token of its own there
            got = np.asarray(self._tokenizer.encode_batch_fast(["\n".join(["", *(pieces[i] for i in part), ""])], add_special_tokens=False)[0].ids, np.uint32)
            feeds = got == self._feed
            cuts = np.flatnonzero(feeds)
            if len(cuts) == len(part) + 1:
                order += part
                sizes.append(np.diff(cuts) - 1)
                ids.append(got[~feeds])
            else:
                odd += part
        for at in range(0, len(odd), 2000):
            part = odd[at : at + 2000]
            got = [x.ids for x in self._tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False)]
            order += part
            sizes.append(np.array([len(x) for x in got], np.int64))
            ids.append(np.array([y for x in got for y in x], np.uint32))
        in_order = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        start, size = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        start[order], size[order] = np.cumsum(in_order) - in_order, in_order
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), start, size

    def _number(self, spelled: str) -> int:
        return self._led[spelled[1:]] if spelled[0] == " " else self._bare[spelled]

    def _learn(self) -> None:
        """Spell out the pieces that were asked for since the last call.

        Letters followed by marks are two tokens of the pre-tokenizer, so most
        pieces with punctuation need no encoding of their own.
        """
        new = self._new
        if not new:
            return
        added = self._some(new)[1]
        asked = len(new)
        spelled = pa.array(new, pa.large_string())
        cores = pc.utf8_rtrim(spelled, characters=_MARKS)
        split = pc.and_(pc.not_equal(cores, spelled), pc.match_substring_regex(cores, pattern=_LETTERS)).to_numpy(zero_copy_only=False)
        if added:
            split[:] = False
        lone, both = np.flatnonzero(~split).tolist(), np.flatnonzero(split).tolist()
        # may ask for more pieces
        parts = [(self._number(core), self._number(new[i][len(core) :])) for i, core in zip(both, cores.take(pa.array(both, pa.int64())).to_pylist(), strict=True)]
        lone += range(asked, len(new))
        ids, start, size = self._spell([new[i] for i in lone])
        self._start = np.concatenate([self._start, np.zeros(len(new), np.int64)])
        self._length = np.concatenate([self._length, np.zeros(len(new), np.int64)])
        own = np.array(lone, np.int64) + self._known
        self._start[own], self._length[own] = len(self._ids) + start, size
        self._ids = np.concatenate([self._ids, ids])
        if both:
            pairs = np.array(parts, np.int64)
            joined = _gather(self._ids, self._start, self._length, pairs.ravel())
            own = np.array(both, np.int64) + self._known
            self._length[own] = self._length[pairs].sum(1)
            self._start[own] = len(self._ids) + np.cumsum(self._length[own]) - self._length[own]
            self._ids = np.concatenate([self._ids, joined])
        self._known += len(new)
        self._new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts back to back, and the number of ids of each text."""
        if self._known > MEMO:
            self._forget()
        bare, led = self._bare.__getitem__, self._led.__getitem__
        numbers: list[np.ndarray | None] = [None] * len(texts)
        plain: list[int] = []
        for i, text in enumerate(texts):
            apart = self._apart is not None and self._apart.search(text) is not None
            if not apart and not self._wide(text):
                plain.append(i)
                continue
            first, *rest = [text] if apart else self.pieces(text)
            numbers[i] = np.array([bare(first), *(led(p[1:]) for p in rest)], np.int64)
        if plain:
            split = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), pattern=" ")
            offsets, words = split.offsets.to_numpy(), split.values
            later = np.ones(len(words), bool)
            later[offsets[:-1]] = False
            # each distinct word of the step is looked up once
            coded = words.filter(pa.array(later)).dictionary_encode()
            own = np.empty(len(words), np.int64)
            own[~later] = np.fromiter(map(bare, words.take(pa.array(offsets[:-1])).to_pylist()), np.int64, len(plain))
            distinct = coded.dictionary.to_pylist()
            fresh = [w for w in distinct if w not in self._led]
            first = self._known + len(self._new)
            self._led.update(zip(fresh, range(first, first + len(fresh))))
            self._new += [f" {w}" for w in fresh]
            own[later] = np.fromiter(map(led, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
            for i, a, b in zip(plain, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                numbers[i] = own[a:b]
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        self._learn()
        at = np.cumsum(sizes) - sizes
        piece = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        ids = _gather(self._ids, self._start, self._length, piece)
        return ids, np.add.reduceat(self._length[piece], at) if len(texts) else np.zeros(0, np.int64)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added: bool = False) -> Encoder:
    if (path, added) not in _ENCODERS:
        _ENCODERS[path, added] = Encoder(path, added=added)
    return _ENCODERS[path, added]


def _in_steps(texts: Iterator, limit: int = 4_000_000) -> Iterator[list]:
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += len(x[1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def write(docs: DataFrame, path: str, tokenizer_path: str, *, added: bool = False) -> None:
    """Encode (doc_id, text) and write the token set at ``path``, in doc_id order; ``added`` as in ``Encoder``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer_path, added)
        no, before = 0, 0
        held_docs: list = []
        held_ids: list[np.ndarray] = []
        held_sizes: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            ids, ends = np.concatenate(held_ids), np.cumsum(np.concatenate(held_sizes))
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part, pa.int32()), (no, pa.int32()), (before, pa.int64()), (len(ids), pa.int64()), (list(held_docs), pa.list_(pa.int64())), (pack_block(ids, ends), pa.binary()))],
                names=["part", "block", "before", "n_ids", "doc_ids", "payload"],
            )

        def all_rows():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

        for step in _in_steps(all_rows()):
            ids, sizes = enc.encode([t for _, t in step])
            ids, sizes = np.insert(ids, np.cumsum(sizes), END_ID), sizes + 1
            held_docs += [doc for doc, _ in step]
            held_ids.append(ids)
            held_sizes.append(sizes)
            held += len(ids)
            if len(held_docs) >= BLOCK_DOCS or held >= BLOCK_IDS:
                yield block()
                no, before = no + 1, before + held
                held_docs, held_ids, held_sizes, held = [], [], [], 0
        if held_docs:
            yield block()

    schema = "part int, block int, before long, n_ids long, doc_ids array<long>, payload binary"
    ordered.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a token set: doc_id, start (global), n_tokens, ids_crc32.

    The only thing the driver gathers is one total for each part.
    """
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, at = {}, 0
    for r in totals:
        starts[r["part"]] = at
        at += r["n"]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, before, docs, payload = (batch.column(c)[i] for c in range(4))
                ids, ef = unpack_block(payload.as_py())
                offset, begin, crc, sizes = starts[part.as_py()] + before.as_py(), 0, [], []
                for at in range(0, ef.n, SAMPLE):
                    for end in ef.values(at, min(SAMPLE, ef.n - at)).tolist():
                        crc.append(zlib.crc32(ids[begin:end].astype("<u4").data))
                        sizes.append(end - begin)
                        begin = end
                size = np.array(sizes, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(np.cumsum(size) - size + offset), pa.array(size), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.select("part", "before", "doc_ids", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
