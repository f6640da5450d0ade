import hashlib
import random
import re
from collections import defaultdict

import pytest

from claimloom.llm import decontamination, graph, near_dup, substring_dedup
from claimloom.llm.near_dup import HASHES, minima, pack

SPACE = r"[^\x20\x09-\x0D]+"


def _near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(30, 120))
        docs.append(base)
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 8)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(copy)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    rng.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "two words"), (905, " Two\twords\n")]


def _groups(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("seed", "size"), [(1, 2), (2, 5)])
def test_near_duplicates_against_brute_force(spark, seed, size):
    rows = _near_copies(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.groups(docs, size=size).collect()}
    assert got == _groups(rows, size, 80)


def test_near_duplicates_of_nothing_and_of_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.groups(empty).count() == 0
    rows = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, None), (7, "x y z")], "doc_id long, text string")
    got = sorted((repr(r.doc_id), repr(r.component_id), r.kept) for r in near_dup.groups(rows, size=2).collect())
    assert got == sorted([("5", "5", True), ("5", "5", True), ("None", "5", False), ("None", "None", True), ("7", "7", True)])


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    monkeypatch.setattr(near_dup, "ROUNDS", 1)
    rows = _near_copies(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.groups(docs, size=2).collect()}
    assert got == _groups(rows, 2, 80)


def test_estimate_is_near_the_truth():
    import numpy as np

    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.8, 1.0):
        both, each = int(1000 * share), (1000 - int(1000 * share)) // 2
        a, b = pool[: both + each], np.concatenate([pool[:both], pool[both + each : both + 2 * each]])
        x, y = (np.frombuffer(pack(minima(s)), np.uint64) for s in (a, b))
        assert abs(float(near_dup.estimate(x, y)) - both / (both + 2 * each)) < 6 * 0.03
    assert len(pack(minima(pool))) * 2 == HASHES


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def _passages(rows, window):
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = re.findall(SPACE, t or "")
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    for i, t in rows:
        w = re.findall(SPACE, t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.setdefault(i, []).append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("window", [6, 50])
def test_passages_against_brute_force(spark, window):
    rng = random.Random(window)
    shared = [[f"s{j}_{rng.randrange(9)}" for _ in range(rng.randint(window - 2, 2 * window))] for j in range(6)]
    rows = []
    for i in range(40):
        parts = [[f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))]]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            parts += [s[rng.randint(0, 3) :], [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 5))]]
        rows.append((i, "  ".join(w for p in parts for w in p)))
    rows += [(50, "r " * 200), (51, "r " * 130 + "q"), (52, rows[3][1]), (52, rows[3][1]), (52, "é è " * window), (None, rows[3][1]), (60, None), (61, ""), (62, "short one"), (63, "\n".join(["é è"] * window))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, mark string").repartition(3)
    got = defaultdict(list)
    for r in substring_dedup.removed_passages(docs, window=window).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == _passages(rows, window)


def test_passages_of_nothing(spark):
    assert substring_dedup.removed_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _leaks(docs, items, size=5):
    out = {}
    grams = lambda t: {tuple(w[k : k + size]) for w in [re.findall(SPACE, (t or "").lower())] for k in range(len(w) - size + 1)}
    for i, t in docs:
        for j, u in items:
            g = grams(u)
            if g and 100 * len(g & grams(t)) >= 80 * len(g):
                n = len(g & grams(t))
                out[(i, j)] = max(out.get((i, j), 0), n)
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 90)))) for i in range(20)] + [(20, None), (21, "too short"), (22, ""), (3, "again " * 8)]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(0, 300))]
        if i % 2:
            part = (rng.choice(items[:20])[1]).split()
            for _ in range(rng.randint(0, max(1, len(part) // 20))):
                part[rng.randrange(len(part))] = word()
            text[5:5] = part
        docs.append((i, " ".join(text)))
    docs += [(None, items[4][1]), (70, None), (71, ""), (72, items[5][1].upper()), (72, items[5][1]), (72, "other"), (73, "x " * 20000 + items[6][1])]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, mark int")
    got = {(r.doc_id, r.item_id): r.n_shared for r in decontamination.pairs(d, b).collect()}
    assert got == _leaks(docs, items)
    clean = decontamination.without_leaks(d, b)
    assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(i) for i, t in docs if not _leaks([(i, t)], items))
    assert decontamination.pairs(d.limit(0), b).count() == 0 and decontamination.pairs(d, b.limit(0)).count() == 0
    assert decontamination.without_leaks(d, b.limit(0)).count() == len(docs)


def test_leaks_with_shuffled_sides(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    items = [(1, "a b c d e f g h")]
    d = spark.createDataFrame([(1, "x a b c d e f g h y"), (2, "nothing of it is here at all")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.pairs(d, spark.createDataFrame(items, "item_id long, text string")).collect()] == [(1, 1)]


def test_misses_are_rare():
    from math import comb

    for n in (24, 32, 48, 64):
        m = decontamination.least_agreeing(n)
        assert m >= n // 4
        assert sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m)) <= decontamination.MISS
