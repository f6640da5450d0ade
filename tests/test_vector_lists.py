import numpy as np
import pytest

from claimloom.operators import retrieval
from claimloom.queries import QUERIES
from claimloom.sources import vectors


def _rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_all_lists_give_the_exact_rows_and_most_find_nine_of_ten(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))]
    data += [(600 + i, data[5][1]) for i in range(300)] + [(2000, None), (2001, []), (2002, [float("nan")] * 8), (2003, [0.0] * 8), (2004, [1.0])]
    docs = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    asked = docs.where("vec_id % 20 = 0 or vec_id > 2000")
    exact = retrieval.dense_topk(docs, asked, k=10)
    vectors.build(docs, str(tmp_path / "i"), lists=20)
    assert _rows(vectors.search(asked, str(tmp_path / "i"), k=10, probed=1.0)) == _rows(exact)
    few, many = (vectors.recall(vectors.search(asked, str(tmp_path / "i"), k=10, probed=p), exact) for p in (0.05, vectors.PROBED))
    assert few < many and many >= 0.9


def test_a_large_list_is_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 50)
    docs = spark.createDataFrame([(i, [1.0, 0.0] if i < 300 else [0.0, 1.0 + i]) for i in range(320)], "vec_id long, embedding array<double>")
    made = vectors.build(docs, str(tmp_path / "i"), lists=2)
    assert max(made["blocks"]) == 6
    asked = docs.where("vec_id in (0, 310)")
    assert _rows(vectors.search(asked, str(tmp_path / "i"), k=4, probed=0.5)) == _rows(retrieval.dense_topk(docs, asked, k=4))


def test_empty_and_missing_index(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    vectors.build(none, str(tmp_path / "i"))
    assert vectors.search(none, str(tmp_path / "i")).count() == 0
    with pytest.raises(ValueError, match="no index"):
        vectors.search(none, str(tmp_path / "other"))


def test_recall_on_the_given_vectors(spark):
    found, exact = (QUERIES[x](spark, "/root/testdata/sf0.001") for x in ("ann_topk", "dense_topk"))
    assert vectors.recall(found, exact) >= 0.9
