"""Sampled segmentations: Gumbel top-k without replacement on the piece lattice.

The pieces of a SentencePiece model get a unigram distribution from their rank
(``(rank + 2) ** -SMOOTHING``, normalised). All segmentations of a text form a lattice;
backward sums give each node's conditional arc probabilities. The search is a
perturbed A*: a node of the search tree is the set of paths that share a prefix
and avoid the arcs already taken after it, its priority is the greatest Gumbel
perturbed log-probability in the set, drawn top-down (a child's value is a
Gumbel truncated at its parent's). Taking sets in order of priority gives ``k``
distinct segmentations without replacement; the (k+1)-th value is the threshold
kappa of the inclusion probability 1 - exp(-exp(log p - kappa)).

Every random number is a hash of the row key, the sample, the place and the
step, so results don't depend on partitions or retries. No piece spans a word
start, so lattices are built once for each distinct word and kept for the
following steps (up to ``VOCABULARY_CHARS``), and all documents of a step are
sampled together in numpy.

Defined cases: a null or empty text has one segmentation, without pieces; a
text with fewer than k segmentations yields them all, with inclusion 1;
characters without a piece become their UTF-8 bytes; U+2581 in a text decodes
to a space, as the format has it; a null key counts as key 0.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import releasing
from .wordhash import mix

SPACE = "▁"
SAMPLES = 2
#: Exponent of the piece probabilities; under 1 it flattens them.
SMOOTHING = 0.4
#: Characters of the texts that are sampled together, and of the words whose lattice is kept.
STEP_CHARS = 300_000
VOCABULARY_CHARS = 1_000_000
#: Words up to this length are summed without logarithms; a character's share of their scale.
PLAIN_CHARS, SCALE = 48, 4.0
_STARTS = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
#: Stands after each word; no piece holds it.
_NO_CHAR = (1 << 21) - 1
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
#: Siblings are sought first among arcs whose prefix is likelier than exp(-NEAR). No uniform
#: number here brings a Gumbel more than TAIL above its location, so it is told what that leaves out.
NEAR, TAIL = 60.0, 37.0


class Pieces:
    """The vocabulary: a trie over code points in a flat hash table."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        rank = np.full(n, float(n))
        for i in usable:
            if sp.get_score(i) > -n:
                rank[i] = -sp.get_score(i)
        weight = (rank + 2) ** -SMOOTHING
        self.log_p = np.log(weight / weight[usable + list(self.byte_of)].sum())
        #: Probabilities scaled by their length.
        self.weight = np.exp(self.log_p + SCALE * np.array(list(map(len, self.text))))
        #: Whether words can be treated on their own: no piece goes on past a word start.
        self.by_word = not any(SPACE in self.text[i].lstrip(SPACE) for i in usable)
        #: What pieces decode to; taken in a row, their bytes are those of the text.
        self.bytes_of = pa.array([bytes([self.byte_of[i]]) if i in self.byte_of else x.encode() for i, x in enumerate(self.text)], pa.binary())
        self.ascii = np.array([self.byte.get(b, -1) for b in range(0x80)], np.int64)

        states: dict[tuple[int, int], int] = {}
        ends = {}
        for i in usable:
            at = 0
            for c in map(ord, self.text[i]):
                at = states.setdefault((at, c), len(states) + 1)
            ends[at] = i
        self.piece_at = np.full(len(states) + 1, -1, np.int64)
        self.piece_at[list(ends)] = list(ends.values())
        bits = max(8, (4 * len(states)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._next = np.zeros(1 << bits, np.int32)
        for (state, c), to in states.items():
            key = state << 21 | c
            slot = (key * int(_MULTIPLIER) & (1 << 64) - 1) >> (64 - bits)
            while self._keys[slot] >= 0:
                slot = slot + 1 & self._mask
            self._keys[slot], self._next[slot] = key, to

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next states, 0 where there is none."""
        key = state.astype(np.int64) << 21 | code
        slot = (key.view(np.uint64) * _MULTIPLIER >> self._shift).astype(np.int64)
        found = self._keys[slot]
        out = np.where(found == key, self._next[slot], 0)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self._mask
            found = self._keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self._next[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        joined = str(self.bytes_of.take(pa.array(ids, pa.int64())).buffers()[2] or b"", "utf-8", "replace")
        return joined.removeprefix(SPACE).replace(SPACE, " ")


class Lattice:
    """Arcs of a growing set of words. Nodes are their characters and, after each word, its end."""

    def __init__(self, pieces: Pieces):
        self._pieces = pieces
        self._room: dict[str, np.ndarray] = {}
        self.spelled = False
        #: First node of each word, first arc of each node, nodes that are ends.
        self.first = np.zeros(0, np.int64)
        self.arc_from = np.zeros(1, np.int64)
        self.is_end = np.zeros(0, bool)
        #: Pieces, lengths and probabilities (given their node) of the arcs.
        self.piece, self.length, self.p = np.zeros(0, np.int32), np.zeros(0, np.int16), np.zeros(0)

    def _append(self, name: str, more: np.ndarray) -> None:
        """Put values behind an array, which is a view of a buffer with room to spare."""
        held = getattr(self, name)
        to = len(held) + len(more)
        room = self._room.get(name)
        if room is None or to > len(room):
            self._room[name] = room = np.empty(2 * to, held.dtype)
            room[: len(held)] = held
        room[len(held) : to] = more
        setattr(self, name, room[:to])

    def add(self, words: list[str]) -> None:
        """Append the arcs of more words."""
        pieces = self._pieces
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        room = sizes + 1
        first = np.cumsum(room) - room
        n = int(room.sum())
        stop = first + sizes
        is_end = np.zeros(n, bool)
        is_end[stop] = True
        code = np.full(n, _NO_CHAR, np.int64)
        code[~is_end] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at, state, depth = np.flatnonzero(~is_end), np.zeros(n - len(words), np.int64), 0
        while len(at):
            state = pieces.step(state, code[at + depth]).astype(np.int64)
            depth += 1
            live = np.flatnonzero(state)
            at, state = at[live], state[live]
            got = pieces.piece_at[state]
            hit = np.flatnonzero(got >= 0)
            found.append((at[hit], got[hit]))
        # a character without a piece of its own is spelled in bytes, as one arc
        single = ~is_end
        if found:
            single[found[0][0]] = False
        odd = np.flatnonzero(single)
        if len(odd):
            found[0] = (np.concatenate([found[0][0], odd]), np.concatenate([found[0][1], -1 - code[odd]]))
            self.spelled = True
        counts = np.zeros(n, np.int64)
        for source, _ in found:
            counts[source] += 1
        arc_from = np.concatenate([[0], np.cumsum(counts)])
        # the longest piece of a node comes first: it mostly is the likeliest, so a draw mostly ends at once
        piece, length = np.empty(int(arc_from[-1]), np.int32), np.empty(int(arc_from[-1]), np.int16)
        used = arc_from[:-1].copy()
        for depth in range(len(found), 0, -1):
            own, got = found[depth - 1]
            where = used[own]
            used[own] += 1
            piece[where], length[where] = got, depth
        p = np.empty(len(piece))
        odd_word = np.zeros(len(words), bool)
        odd_word[np.searchsorted(first, odd, side="right") - 1] = True
        # products of scaled probabilities; logarithms where they might leave the range of doubles
        by_log = odd_word | (sizes > PLAIN_CHARS)
        left = np.repeat(stop, room) - np.arange(n)
        for logs in (False, True):
            chosen = np.flatnonzero(np.repeat(by_log == logs, room) & ~is_end)
            if not len(chosen):
                continue
            backward = np.zeros(n) if logs else np.ones(n)
            # arcs in the order of their nodes' distance from the word's end
            by_left = chosen[np.argsort(left[chosen].astype(np.int32), kind="stable")]
            c = counts[by_left]
            edge = np.cumsum(c) - c
            arcs = np.repeat(arc_from[by_left] - edge, c) + np.arange(int(c.sum()))
            own, to = piece[arcs], np.repeat(by_left, c) + length[arcs]
            value = np.where(own >= 0, pieces.log_p[np.maximum(own, 0)], self._spelling(own)) if logs else pieces.weight[own]
            cut = np.cumsum(np.bincount(left[chosen]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if a == b:
                    continue
                i, j = int(edge[a]), int(edge[b]) if b < len(edge) else len(arcs)
                if logs:
                    value[i:j] += backward[to[i:j]]
                    backward[by_left[a:b]] = np.logaddexp.reduceat(value[i:j], edge[a:b] - i)
                else:
                    value[i:j] *= backward[to[i:j]]
                    backward[by_left[a:b]] = np.add.reduceat(value[i:j], edge[a:b] - i)
            total = np.repeat(backward[by_left], c)
            p[arcs] = np.exp(value - total) if logs else value / total
        sure = p >= 1
        sure[arc_from[:-1][counts == 1]] = False
        p[sure] = 1 - 2**-53  # only a lone arc is certain
        nodes, arcs = len(self.is_end), len(self.p)
        for name, more in (("first", first + nodes), ("arc_from", arc_from[1:] + arcs), ("is_end", is_end), ("piece", piece), ("length", length), ("p", p)):
            self._append(name, more)

    def _spelling(self, coded: np.ndarray) -> np.ndarray:
        """Log-probability of a character that is spelled in bytes."""
        code = np.maximum(-1 - coded, 0)
        byte_p = self._pieces.log_p[next(iter(self._pieces.byte_of))] if self._pieces.byte_of else -30.0
        return (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)) * byte_p

    def log_c(self, arcs: np.ndarray) -> np.ndarray:
        """Log-probabilities of arcs given their nodes."""
        return np.log(np.maximum(self.p[arcs], 1e-300))

    def log_rest(self, arcs: np.ndarray) -> np.ndarray:
        """Log-probabilities of all other arcs of the same nodes; nothing where there is none."""
        rest = 1 - self.p[arcs]
        return np.log(np.maximum(rest, 1e-18), out=np.full(len(rest), -np.inf), where=self.p[arcs] < 1)

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An arc of each node, by uniform numbers."""
        arc, last = self.arc_from[node], self.arc_from[node + 1] - 1
        sums = self.p[arc]
        open_ = np.flatnonzero((sums <= u) & (arc < last))
        while len(open_):
            arc[open_] += 1
            sums[open_] += self.p[arc[open_]]
            open_ = open_[(sums[open_] <= u[open_]) & (arc[open_] < last[open_])]
        return arc

    def draw_one(self, node: int, u: float) -> int:
        """``draw`` of a single node."""
        arc, last = int(self.arc_from[node]), int(self.arc_from[node + 1]) - 1
        total = self.p[arc]
        while total <= u and arc < last:
            arc += 1
            total += self.p[arc]
        return arc


class Vocabulary:
    """Words met so far, numbered in the order they are first asked for, and their lattice."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.lattice = Lattice(self.pieces)
        #: Words by their text without the space mark before it, where no other mark is near.
        self._number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self._chars = 0

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts back to back as numbers, and the number of words of each text."""
        if self._chars > VOCABULARY_CHARS:
            self._forget()
        words: list[str] = []
        ends = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                pass
            elif not self.pieces.by_word:
                words.append(SPACE + text.replace(" ", SPACE))
            elif SPACE in text or "  " in text or text[-1] == " " or text[0] == " ":
                words += _STARTS.split(SPACE + text.replace(" ", SPACE))
            else:
                words += text.split(" ")
            ends[i] = len(words)
        known, before = self._number, len(self._number)
        numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        # those that the lookups have just numbered stand last
        new = [w if w[0] == SPACE else SPACE + w for w in itertools.islice(reversed(known), len(known) - before)][::-1]
        if new:
            self._chars += sum(map(len, new))
            self.lattice.add(new)
        return numbers, np.diff(ends, prepend=0)


def _keyed(seed: np.ndarray, a, b) -> np.ndarray:
    """Keys that depend on all arguments alone."""
    with np.errstate(over="ignore"):
        return mix(seed + np.asarray(a, np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.asarray(b, np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


def _uniform_of(key: np.ndarray, c) -> np.ndarray:
    """Uniform numbers in (0, 1) of mixed keys and a step."""
    with np.errstate(over="ignore"):
        x = key + np.asarray(c, np.uint64) * np.uint64(0xAAAAAAAAAAAAAAAB)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    x >>= np.uint64(12)
    out = x.astype(np.float64)
    out += 0.5
    out *= 1 / float(1 << 52)
    return out


def _uniform(seed: np.ndarray, a, b, c) -> np.ndarray:
    """Uniform numbers in (0, 1) that depend on all arguments alone."""
    return _uniform_of(_keyed(seed, a, b), c)


def _uniform_one(own: int, a: int, b: int, c: int) -> float:
    """``_uniform`` of a single key, without arrays."""
    x = own + a * 0xD1B54A32D192ED03 + b * 0x8CB92BA72F3D8DD7 & _MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    x = (x ^ x >> 31) + c * 0xAAAAAAAAAAAAAAAB & _MASK
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & _MASK
    return ((x ^ x >> 29) >> 12) * 2.0**-52 + 2.0**-53


def _truncated_one(phi: float, bound: float, u: float) -> float:
    """``_truncated`` of a single location, from a uniform number."""
    return float(phi - np.log(np.exp(min(phi - bound, 700.0)) - np.log(u)))


def _truncated(phi, bound, e):
    """A Gumbel with location phi, truncated at bound, from an exponential number e."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isneginf(phi), -np.inf, phi - np.log(np.exp(np.minimum(phi - bound, 700.0)) + e))


class _Path:
    """Arcs that one sample draws anew: those of the words from ``begin`` on of each document."""

    def __init__(self, lattice: Lattice, word: np.ndarray, seed: np.ndarray, place: np.ndarray, doc_words: np.ndarray, sample: int, begin: np.ndarray):
        steps, arcs = [], []
        live = np.flatnonzero(place >= np.repeat(begin, np.diff(doc_words))) if sample else np.arange(len(word))
        node, key = lattice.first[word[live]], _keyed(seed[live], sample, place[live])
        t = 0
        while len(live):
            arc = lattice.draw(node, _uniform_of(key, t))
            steps.append(live)
            arcs.append(arc)
            node = node + lattice.length[arc]
            on = np.flatnonzero(~lattice.is_end[node])
            live, node, key, t = live[on], node[on], key[on], t + 1
        self.n_of = np.zeros(len(word), np.int64)
        for rows in steps:
            self.n_of[rows] += 1
        self.first = np.concatenate([[0], np.cumsum(self.n_of)])
        self.arcs = np.empty(int(self.first[-1]), np.int64)
        for t, (rows, got) in enumerate(zip(steps, arcs, strict=True)):
            self.arcs[self.first[rows] + t] = got
        #: First arc of each document.
        self.doc = self.first[doc_words]


def sample_step(pieces: Pieces, keys: np.ndarray, texts: list[str], k: int, seed: int = 0, vocabulary: Vocabulary | None = None) -> list[list[tuple]]:
    """For each text up to k samples: (ids, log p, perturbed log p, log inclusion)."""
    vocabulary = vocabulary or Vocabulary(pieces)
    word, counts = vocabulary.numbered(texts)
    lattice = vocabulary.lattice
    doc_words = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        own = mix(keys.astype(np.int64).view(np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(seed))
    place = np.arange(len(word)) - np.repeat(doc_words[:-1], counts)
    of_word = np.repeat(own, counts)

    n = len(texts)
    spelled = lattice.spelled
    root = -np.log(-np.log(_uniform(own, 0, 1 << 40, 0)))
    # by document: open sets (-priority, tie, chosen prefix arcs, node, excluded arcs, log p of prefix)
    agenda: list[list] = [[(-root[d], 0, None, None, (), 0.0)] if counts[d] else [] for d in range(n)]
    out: list[list[list]] = [[] for _ in range(n)]
    for s in range(k):
        popped = [heapq.heappop(held) if held else None for held in agenda]
        # the words before a deviation, and its own, are settled already
        begin = np.array([counts[d] if x is None else 0 if x[2] is None else x[2][1] + 1 for d, x in enumerate(popped)], np.int64)
        fresh = _Path(lattice, word, of_word, place, doc_words, s, begin)
        log_c = lattice.log_c(fresh.arcs)
        # sums up to each arc, of each text by itself: the same numbers in any batch
        run = np.zeros(len(log_c) + 1)
        for a, b in zip(fresh.doc[:-1].tolist(), fresh.doc[1:].tolist(), strict=True):
            np.cumsum(log_c[a:b], out=run[a + 1 : b + 1])
        bound, shift, skip = np.full(n, -np.inf), np.zeros(n), np.zeros(n, np.int64)
        heads: list = [None] * n
        for d in range(n):
            if popped[d] is None:
                continue
            priority, _, prefix, node, excluded, log_prefix = popped[d]
            bound[d] = limit = -priority
            a = int(fresh.doc[d])
            if prefix is None:
                heads[d] = ()
                continue
            # the word of the deviation: an arc not yet taken, then on to the word's end
            w, key = int(prefix[1]), int(own[d])
            arcs, total = list(prefix[0]), log_prefix
            choice = [arc for arc in range(int(lattice.arc_from[node]), int(lattice.arc_from[node + 1])) if arc not in excluded]
            p = lattice.p[choice]
            u = _uniform_one(key, s, 1 << 42, len(arcs)) * p.sum()
            arc = choice[min(int(np.searchsorted(np.cumsum(p), u, side="right")), len(choice) - 1)]
            if len(choice) > 1:
                phi = log_prefix + np.log(max(float(p.sum() - lattice.p[arc]), 1e-18))
                g = _truncated_one(phi, limit, _uniform_one(key, s, 1 << 43, len(arcs)))
                heapq.heappush(agenda[d], (-g, s * 2 + 1, prefix, node, (*excluded, arc), log_prefix))
            arcs.append(arc)
            total += math.log(max(lattice.p[arc], 1e-300))
            node, t = node + int(lattice.length[arc]), 1
            while not lattice.is_end[node]:
                arc = lattice.draw_one(node, _uniform_one(key, s, 1 << 44, t))
                if lattice.arc_from[node + 1] - lattice.arc_from[node] > 1:
                    phi = total + math.log(max(1 - lattice.p[arc], 1e-18))
                    g = _truncated_one(phi, limit, _uniform_one(key, s, 1 << 45, t))
                    heapq.heappush(agenda[d], (-g, s * 2 + 2 + t, (tuple(arcs), w), node, (arc,), total))
                arcs.append(arc)
                total += math.log(max(lattice.p[arc], 1e-300))
                node, t = node + int(lattice.length[arc]), t + 1
            heads[d] = tuple(arcs)
            skip[d] = fresh.first[doc_words[d] + w + 1] - a  # arcs of the fresh path up to that word
            shift[d] = total - (run[a + skip[d]] if skip[d] else 0.0)
        # siblings of the fresh part of each path
        begins = fresh.doc[:-1] + skip
        of_doc, at, g, before = _siblings(lattice, fresh, run, _keyed(own, s, 1 << 41), begins, bound, shift, k + 1 - s)
        in_word = np.searchsorted(fresh.first, at, side="right") - 1 - doc_words[of_doc]
        source = np.searchsorted(lattice.arc_from, fresh.arcs[at], side="right") - 1
        for d, i, priority, log_prefix, w, node in zip(*(x.tolist() for x in (of_doc, at, -g, before, in_word, source)), strict=True):
            prefix = (*heads[d], *fresh.arcs[begins[d] : i].tolist())
            heapq.heappush(agenda[d], (priority, s * 1000 + 500, (prefix, w), node, (int(fresh.arcs[i]),), log_prefix))
        for d in range(n):
            if heads[d] is not None:
                a, b = int(fresh.doc[d]), int(fresh.doc[d + 1])
                arcs = np.concatenate([np.array(heads[d], np.int64), fresh.arcs[a + skip[d] : b]])
                out[d].append([_ids(pieces, lattice.piece[arcs], spelled), float((run[b] if b > a else 0.0) + shift[d]), float(bound[d])])
    result: list[list[tuple]] = []
    for d in range(n):
        if not counts[d]:
            result.append([(np.zeros(0, np.int64), 0.0, float(root[d]), 0.0)])
            continue
        kappa = -agenda[d][0][0] if agenda[d] else -np.inf
        result.append([(ids, lp, g, _log_inclusion(lp, kappa)) for ids, lp, g in out[d]])
    return result


def _siblings(lattice: Lattice, fresh: _Path, run: np.ndarray, key: np.ndarray, begins: np.ndarray, bound: np.ndarray, shift: np.ndarray, most: int) -> tuple:
    """Of each document, the arcs from ``begins`` on with the greatest Gumbels of what leaves the path there, ``most`` at most.

    Documents, places of the arcs, Gumbels, and log-probabilities of the prefixes. Prefixes get
    less likely along a path, so few arcs at its begin are likely to hold the greatest.
    """
    n, ends = len(begins), fresh.doc[1:]
    stops, floor = begins.copy(), np.full(n, -np.inf)
    for d in np.flatnonzero((begins < ends) & ~np.isneginf(bound)).tolist():
        a, b = int(begins[d]), int(ends[d])
        start = run[a] if a > fresh.doc[d] else 0.0
        stops[d] = a + 1 + np.searchsorted(-run[a + 1 : b], NEAR - start)
        if stops[d] < b:
            floor[d] = run[stops[d]] + shift[d] + TAIL
    while True:
        size = stops - begins
        doc_of = np.repeat(np.arange(n), size)
        at = np.arange(len(doc_of)) - np.repeat(np.cumsum(size) - size, size) + begins[doc_of]
        within = at - fresh.doc[doc_of]
        before = np.where(within > 0, run[at], 0.0)
        e = -np.log(_uniform_of(key[doc_of], within))
        g = _truncated(before + lattice.log_rest(fresh.arcs[at]) + shift[doc_of], bound[doc_of], e)
        some = np.flatnonzero(~np.isneginf(g))
        some = some[np.lexsort((-g[some], doc_of[some]))]
        count = np.bincount(doc_of[some], minlength=n)
        order = np.arange(len(some)) - np.repeat(np.cumsum(count) - count, count)
        some = some[order < most]
        sure = np.bincount(doc_of[some][g[some] > floor[doc_of[some]]], minlength=n) >= most
        short = np.flatnonzero(~sure & (stops < ends) & (stops > begins))
        if not len(short):
            return doc_of[some], at[some], g[some], before[some] + shift[doc_of[some]]
        stops[short] = ends[short]
        floor[short] = -np.inf


def _log_inclusion(log_p: float, kappa: float) -> float:
    """log(1 - exp(-exp(log_p - kappa))), also where the inclusion underflows."""
    x = log_p - kappa
    if x < -30:
        return x
    return float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))


def _ids(pieces: Pieces, coded: np.ndarray, spelled: bool) -> np.ndarray:
    odd = np.flatnonzero(coded < 0) if spelled else ()
    if not len(odd):
        return coded
    code = -1 - coded[odd]
    coded[odd] = np.where(code < 0x80, pieces.ascii[np.minimum(code, 0x7F)], coded[odd])
    if coded.min() >= 0:
        return coded
    out: list[int] = []
    for c in coded.tolist():
        out += [c] if c >= 0 else [pieces.byte[b] for b in chr(-1 - c).encode("utf-8", "surrogatepass")]
    return np.array(out, np.int64)


_LOADED: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= STEP_CHARS:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _run(path: str, k: int, seed: int, emit, names: list[str], types: list[pa.DataType]):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        vocabulary = Vocabulary(pieces)
        for keys, texts in _steps(batches):
            got = sample_step(pieces, np.array([x or 0 for x in keys], np.int64), texts, k, seed, vocabulary)
            rows = [emit(pieces, key, text, i + 1, *s) for key, text, ss in zip(keys, texts, got, strict=True) for i, s in enumerate(ss)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _full(pieces, key, text, no, ids, log_p, g, inclusion):
    return key, no, ids.astype(np.int32), log_p, g, inclusion


def _digest(pieces, key, text, no, ids, log_p, g, inclusion):
    return key, no, len(ids), zlib.crc32(ids.astype("<u4").data), log_p, g, inclusion, pieces.decode(ids) == text.replace(SPACE, " ")


def encode(docs: DataFrame, path: str, *, k: int = SAMPLES, seed: int = 0) -> DataFrame:
    """Sampled ids of every row of (doc_id, text), up to k rows each."""
    names = ["doc_id", "sample", "ids", "log_prob", "perturbed", "log_inclusion"]
    types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.float64()]
    schema = "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_run(path, k, seed, _full, names, types), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the column ``text`` of its ``ids``."""
    where = encoded.columns.index("ids")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))


def samples(docs: DataFrame, path: str, *, k: int = SAMPLES, seed: int = 0) -> DataFrame:
    """As ``encode``, with counts and checksums for the ids and the decoding checked."""
    names = ["doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "log_inclusion", "decodes"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
    schema = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, decodes boolean"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_run(path, k, seed, _digest, names, types), schema)
