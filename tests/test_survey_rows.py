import json

from pyspark.sql import functions as F

from claimloom.functions import text as tx
from claimloom.operators import evidence, store


def one(spark, c, *values):
    return spark.range(1).select(c(*[F.lit(v) for v in values]).alias("x")).first()["x"]


def test_print_noise_leaves_evidence_sentences(spark):
    noisy = "Page Proof Pending Publication The court held so. Cite as: 601 US 1 (2024) It must stand.\n12 SMITH v. JONES CO. Opinion of the Court The rule applies. Pp. 12–14. See pp. 3-4 there. Cite as: 602 U.S. 5 (2025) Done."
    rows = spark.createDataFrame([(noisy,)], "text string")
    # a 'Cite as' with full stops before its year is not noise
    assert rows.select(evidence.sentences("text")).first()[0] == ["The court held so.", "It must stand.", "The rule applies. .", "See there.", "Cite as: 602 U.S.", "5 (2025) Done."]


def test_citation_is_the_first_whole_one(spark):
    kind = "array<struct<volume: long, reporter: string, page: string>>"
    rows = [([(None, "U.S.", "1"), (0, "U.S.", "1"), (384, "", "2"), (384, "U.S.", "436"), (1, "F.", "2")],), ([],), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, f"c {kind}").select(tx.citation("c")).collect()] == ["384 U.S. 436", None, None]


def test_conversation_summary(spark):
    assert one(spark, tx.conversation_summary, " a \n b ", "c  d") == "Q: a b\nA: c d"
    assert one(spark, tx.conversation_summary, "a", "  ") == "Q: a"
    got = one(spark, tx.conversation_summary, "q" * 993, "rest")
    assert got == f"Q: {'q' * 993}..."
    assert len(one(spark, tx.conversation_summary, "q" * 989, "rest")) == 1000 and one(spark, tx.conversation_summary, "q", "r" * 993).endswith("...")


def test_violations(spark):
    users = spark.createDataFrame([(1, "a", "n"), (2, "a", "m"), (2, None, "o"), (3, None, "p")], "id long, email string, username string")
    talks = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id long, user_id long")
    got = {(r.table_name, r.rule, r.key, r.n) for r in store.violations({"users": users, "conversations": talks}).collect()}
    assert got == {("users", "unique id", '{"id":2}', 2), ("users", "unique email", '{"email":"a"}', 2), ("conversations", "user_id in users", '{"user_id":9}', 1)}


def test_citation_links(spark):
    stored = spark.createDataFrame([(10, 1), (11, 1), (12, 1), (20, 2)], "id long, interaction_id long")
    cited = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (3, 1, "y"), (4, 1, None), (5, 2, "y")], "id long, interaction_id long, chunk_id string")
    claims = [(1, 0, "c0", "SUPPORTED", "x", "y", 0.9, 0.1, "y", 0.2), (1, 1, None, None, "", "y", None, 0.4, "z", 0.3), (2, 0, "d0", "SUPPORTED", "x", None, 1.0, None, None, None), (2, 1, "d1", "SUPPORTED", "y", None, 1.0, None, None, None)]
    said = spark.createDataFrame(claims, "interaction_id long, position long, claim_id string, verdict string, best_supporting_chunk string, best_chunk string, best_supporting_score double, final_score double, best_contradicting_chunk string, best_contradiction_score double")
    rows = store.citation_links(stored, cited, said).collect()
    assert {(r.verified_claim_id, r.interaction_citation_id, r.relationship, r.score) for r in rows} == {(10, 2, "supporting", 0.9), (10, 3, "contradicting", 0.2), (11, 3, "supporting", 0.4)}
    assert {"claim_id": None, "chunk_id": "y", "relationship": "supporting", "verdict": None} in [json.loads(r.metadata_json) for r in rows]
