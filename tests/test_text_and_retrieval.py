import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.functions import text as tx
from claimloom.operators import chunking, expansion, retrieval


def test_word_windows(spark):
    docs = spark.createDataFrame([("d", " ".join(f"word{i}" for i in range(12))), ("e", None), ("f", "  ")], "doc_id string, text string")
    rows = chunking.word_windows(docs, size=5, overlap=2).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in rows] == ["d:0", "d:1", "d:2", "d:3"]
    assert rows[0].text == "word0 word1 word2 word3 word4"
    assert rows[1].text == "word3 word4 word5 word6 word7"
    assert rows[3].text.split()[-1] == "word11"


def test_windows_cover_all_words(spark):
    docs = spark.createDataFrame([(n, " ".join(map(str, range(n)))) for n in range(1, 40)], "doc_id long, text string")
    for r in chunking.word_windows(docs, size=7, overlap=3).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(F.split("text", " ")))).alias("w")).collect():
        assert set(r.w) == {str(i) for i in range(r.doc_id)}


def test_paragraphs(spark):
    docs = spark.createDataFrame([("d", "\n\n".join("x" * 40 + f" {i}" for i in range(3)))], "doc_id string, text string")
    assert chunking.paragraph_chunks(docs, size=80, overlap=20).count() > 1


def test_bm25_order(spark):
    chunks = spark.createDataFrame([("a", "warrant required for cellphone search"), ("b", "search search search warrant exception"), ("c", "tax dispute and venue transfer")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "search warrant")], "query_id long, text string")
    rows = retrieval.bm25_topk(chunks, asked, k=2).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["b", "a"]
    assert all(r.score > 0 for r in rows)


def test_bm25_matches_the_formula(spark):
    texts = {"a": "x y y", "b": "x z", "c": "z z z w"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "x z z")], "query_id long, text string")
    got = {r.chunk_id: r.score for r in retrieval.bm25_topk(chunks, asked).collect()}
    tokens = {k: v.split() for k, v in texts.items()}
    mean = sum(map(len, tokens.values())) / 3
    for key, words in tokens.items():
        score = 0
        for term in ("x", "z", "z"):
            df, tf = sum(term in w for w in tokens.values()), words.count(term)
            score += math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
        assert math.isclose(got.get(key, 0), score, abs_tol=1e-5)


def test_fusion(spark):
    lists = spark.createDataFrame([(1, "a", 1), (1, "c", 2), (1, "b", 1), (1, "a", 2)], "query_id long, chunk_id string, rank long")
    assert [r.chunk_id for r in retrieval.fuse(lists).orderBy("fused_rank").collect()] == ["a", "b", "c"]


@settings(max_examples=5, deadline=None)
@given(st.permutations([("a", 1), ("b", 2), ("a", 3), ("c", 1), ("b", 1)]))
def test_fusion_ignores_order(spark, rows):
    lists = spark.createDataFrame([(1, k, r) for k, r in rows], "query_id long, chunk_id string, rank long")
    assert [r.chunk_id for r in retrieval.fuse(lists).orderBy("fused_rank").collect()] == ["b", "a", "c"]


def test_one_backend_may_fail(spark):
    hits = spark.createDataFrame([(1, "a", 1)], "query_id long, chunk_id string, rank long")

    def broken():
        raise RuntimeError

    lists, status = retrieval.hybrid(lambda: hits, broken)
    assert status == "warning:dense:RuntimeError" and lists.count() == 1


def test_backfill(spark):
    rows = spark.createDataFrame([("x", None, 1), ("x", " ", 2), ("x", "name", 3)], "id string, case_name string, ord int")
    assert retrieval.backfilled(rows, ["id"], ["case_name"], "ord").first().case_name == "name"


def test_expansion(spark):
    asked = ["find cases about standing for environmental plaintiffs", "What did Miranda v. Arizona say about suppression?", " ", "hello there you"]
    rows = expansion.plans(spark.createDataFrame([(q,) for q in asked], "query string"), mode="rule").collect()
    by = {r["query"]: r for r in rows}
    assert by[asked[0]].status == "applied" and any("injury in fact" in v for v in by[asked[0]].variants)
    assert by[asked[1]].status == "not_applied:named_authority_query"
    assert by[""].status == "not_applied:blank_query"
    assert by[asked[3]].status == "not_applied:not_broad_research_query"


def test_names(spark):
    r = spark.createDataFrame([("My File.txt", "text", "a/b*c?.txt..")], "n string, t string, f string").select(tx.upload_id("n", "t").alias("id"), tx.safe_filename("f").alias("f"), tx.shortened(F.lit("a " * 50), 20).alias("s")).first()
    assert r.id.startswith("upload_my-file_") and len(r.id) == len("upload_my-file_") + 10
    assert r.f == "b_c_.txt"
    assert r.s.endswith("...") and len(r.s) <= 20
