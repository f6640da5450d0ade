import pytest
from pyspark.sql import functions as F

from claimloom import queries as base
from claimloom.operators import retrieval
from claimloom.queries import searching


def _tables(spark, folder, documents, vectors=((0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.0, 1.0]))):
    for name, rows, schema in (
        ("documents", documents, "doc_id long, text string, lang string, source string, n_chars long"),
        ("benchmark", [(0, "quasar nebula")], "item_id long, text string"),
        ("embeddings", list(vectors), "vec_id long, embedding array<double>"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _documents(*ids):
    return [(i, f"quasar number {n}", "en", "s", 15) for n, i in enumerate(ids)]


@pytest.mark.parametrize("name", ["rerank_stable", "rrf_fusion", "hybrid_projection"])
def test_a_failed_sparse_search_is_no_result(spark, tmp_path, name):
    # ids given twice can't be indexed; the dense list alone went on as if it were the fused one
    at = _tables(spark, tmp_path, _documents(5, 6, 6))
    with pytest.raises(ValueError, match="unique"):
        base.QUERIES[name](spark, at).collect()


def test_a_failed_dense_search_is_no_result(spark, tmp_path, monkeypatch):
    at = _tables(spark, tmp_path, _documents(5, 6))
    down = spark.range(1).select(F.col("id").alias("query_id"), F.lit(1).alias("vec_id"), F.raise_error(F.lit("down")).cast("long").alias("rank"))
    monkeypatch.setattr(searching, "dense", lambda *a, **b: down)
    with pytest.raises(Exception, match="down"):  # it fails while it runs, with its own message
        base.QUERIES["rerank_stable"](spark, at).collect()


def test_sound_searches_are_both_fused(spark, tmp_path):
    at = _tables(spark, tmp_path, _documents(5, 6))
    rows = base.QUERIES["rrf_fusion"](spark, at).collect()
    assert {r.chunk_id for r in rows} == {"1:0", "2:0", "5:0", "6:0"}
    assert {r.chunk_id for r in base.QUERIES["rerank_stable"](spark, at).collect()} == {r.chunk_id for r in rows}


@pytest.mark.parametrize("part", ["documents", "embeddings"])
def test_an_empty_table_is_no_failure(spark, tmp_path, part):
    at = _tables(spark, tmp_path, [] if part == "documents" else _documents(5, 6), *([()] if part == "embeddings" else []))
    got = {r.chunk_id for r in base.QUERIES["rerank_stable"](spark, at).collect()}
    assert got == ({"1:0", "2:0"} if part == "documents" else {"5:0", "6:0"})


def test_hybrid_asked_for_the_whole(spark):
    hits = spark.createDataFrame([(1, "a", 1)], "query_id long, chunk_id string, rank long")

    def broken():
        raise OSError("disk full")

    with pytest.raises(OSError, match="disk full"):
        retrieval.hybrid(lambda: hits, broken, whole=True)
    with pytest.raises(OSError, match="disk full"):
        retrieval.hybrid(broken, lambda: hits, whole=True)
    lists, status = retrieval.hybrid(lambda: hits, lambda: hits, whole=True)
    assert status == "ok" and lists.count() == 2
