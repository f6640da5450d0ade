import random

import numpy as np
import pytest

from claimloom.llm import topk


def _search(spark, rows, k):
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.search(vectors, vectors.where("vec_id % 5 = 0"), k=k).collect()
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in got}


def _brute(rows, k):
    ints = {i: [int(np.floor(64 * np.float64(np.float32(x)))) for x in v] for i, v in rows}
    out = set()
    for q in ints:
        if q % 5 == 0:
            scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("top", [1.0, 3e6, 2e7, 2.2e7])
def test_large_components_count_in_full(spark, top):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * (top if i % 3 else 1) for _ in range(4)]) for i in range(60)]
    assert _search(spark, rows, 7) == _brute(rows, 7)


def test_lowest_scores_are_found(spark):
    rows = [(5, [4e7]), (6, [-2.1e7]), (7, [-2.0e7])]
    assert _search(spark, rows, 2) == _brute(rows, 2)


def test_scores_without_a_form_are_an_error(spark):
    for big in (1e12, 1e19):
        with pytest.raises(Exception, match="no 64-bit form"):
            _search(spark, [(5, [big]), (6, [big])], 2)
