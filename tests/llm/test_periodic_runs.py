import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from claimloom.llm import periodic_runs, wordhash
from claimloom.llm.queries import QUERIES


def brute(w, min_length, min_exponent):
    out = []
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            seg = w[i : i + n]
            if j > i and n >= max(min_length, min_exponent * q) and not any(seg[r:] == seg[: n - r] for r in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent,length", [(4, 6), (3, 2), (2, 2)])
def test_runs_equal_brute_force(exponent, length):
    rng = random.Random(exponent)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.choice([0, 1, 2, 5, 20, 60]), rng.choice([1, 2, 3, 8])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 9)
                w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            texts.append(w)
        first = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
        got = periodic_runs.runs_of(np.array([x for w in texts for x in w], np.int64), first, length, exponent)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == [(d, *r) for d, w in enumerate(texts) for r in brute(w, length, exponent)]


@pytest.mark.parametrize("values", [np.random.default_rng(0).permutation(500), np.r_[0, np.arange(900, 0, -1)], np.arange(300), np.zeros(40, np.int64)])
def test_next_smaller(values):
    got = periodic_runs.next_smaller(values.astype(np.int32))
    want = [next((j for j in range(i + 1, len(values)) if values[j] <= values[i]), len(values)) for i in range(len(values))]
    assert got.tolist() == want


def test_very_long_periodic_text():
    n = 200_000
    for q in (1, 700, 49_999):
        got = periodic_runs.runs_of(np.arange(n) % q, np.array([0, n]), 6, 4)
        assert [x.tolist() for x in got] == [[0], [0], [n], [q]]


def test_words_with_equal_hashes_are_told_apart():
    w = wordhash.split_words(__import__("pyarrow").array(["aa b aa c", "b aa"]))
    assert len(set(wordhash.exact_ids(w).tolist())) == 3
    w.hashes[:] = 7
    ids = wordhash.exact_ids(w).tolist()
    assert ids[0] == ids[2] == ids[5] and ids[1] == ids[4] and len(set(ids)) == 3


def test_defined_cases(spark):
    schema = "runs string, doc_id long, n_words string, text string, length long"
    rows = [("x", None, "y", None, 1), ("x", 1, "y", "", 1), ("x", 2, "y", "a  a\ta a\na a b", 1), ("x", 2, "y", "a  a\ta a\na a b", 1), ("x", 3, "y", "a b c d e f", 1)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in periodic_runs.find(docs).collect()))
    assert got == [(0, 0, [], ""), (1, 0, [], ""), (2, 7, [(0, 6, 1)], "a b"), (2, 7, [(0, 6, 1)], "a b"), (3, 6, [], "a b c d e f")]
    assert periodic_runs.find(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        periodic_runs.find(docs, min_exponent=1)


def _expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute(w, 6, 4)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_query_on_a_whole_table(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["é", "b", "cc", "d,"], k=rng.randint(0, 80)))) for i in range(150)] + [(None, "x y"), (7, None), (9, " \n"), (11, "a b " * 60), (11, "a b " * 60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((_expected(*r) for r in rows), key=key)
