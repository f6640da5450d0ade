import random

import numpy as np

from claimloom.llm import topk


def _brute(rows, asks, k):
    out = {}
    for q in {i for i, _ in rows if asks(i)}:
        a = min(v for i, v in rows if i == q)
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def _search(spark, rows, k):
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = {}
    for r in topk.search(vectors, vectors.where("vec_id % 20 = 0"), k=k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_repeated_rows_count_each(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randint(-30, 30) for _ in range(5)]) for i in range(120)]
    rows += [rows[7]] * 9 + [rows[20]] * 6 + [(33, [29, 29, -29, 29, 29])] * 3
    want = _brute(rows, lambda i: i % 20 == 0, 6)
    assert _search(spark, rows, 6) == want


def test_many_blocks_and_packs(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "SHARD", 8)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = random.Random(5)
    centres = [[rng.randint(-60, 60) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + rng.randint(-9, 9) for x in centres[0 if i % 3 == 0 else i % 4]]) for i in range(400)]
    assert _search(spark, rows, 9) == _brute(rows, lambda i: i % 20 == 0, 9)


def test_first_thresholds_are_reached_by_other_rows():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (60, 8))
    ids = np.arange(60)
    got = topk.first_thresholds(x[:9], ids[:9], x, ids, 5)
    for i in range(9):
        assert got[i] == sorted((int(x[i] @ x[j]) for j in range(60) if j != i), reverse=True)[4]
    assert (topk.first_thresholds(x[:9], ids[:9], x[:4], ids[:4], 5) == topk._NONE).all()
