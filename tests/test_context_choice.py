from pyspark.sql import functions as F

from claimloom.operators import context

HITS = "query_id long, chunk_id string, doc_id long, rank int, doc_type string, case_name string, text string"
ASKED = "query_id long, question string, target_case string, target_doc_ids array<long>, depth string, leads boolean"


def _run(spark):
    hits = [(q, f"{q}-{r}", r % 4, r, "user_upload" if q in (2, 3) and r in (3, 5) else "case", "Smith v. Jones" if r % 4 == 1 else "Roe v. Wade", f"Text {r}.") for q in (0, 1, 2, 3, 4, 5, 6) for r in range(1, 13)]
    asked = [(0, "q", None, None, "concise", False), (1, "q", "Smith v Jones", None, "Detailed", False), (2, "q", "Smith v. Jones", None, None, True), (3, "compare it with precedent", None, None, None, None),
             (4, "q", "Doe v. Poe", None, None, False), (5, "q", "Doe v. Poe", [2], None, True), (6, "q", "Smith v Jones", None, None, False), (7, "no hits", None, None, "detailed", False)]
    questions = spark.createDataFrame(asked, ASKED)
    chosen = context.prompt_chunks(spark.createDataFrame(hits, HITS), questions)
    said = spark.createDataFrame([(1, r, f"1-{c}", f"Said {c}.", 1.0) for r, c in enumerate([9, 5, 1, 2], 1)] + [(4, 1, "4-1", "Said.", 2.0)], "query_id long, rank int, chunk_id string, sentence string, score double")
    return questions, chosen, said, context.choice(chosen, questions, said)


def test_chunks_and_kinds_of_context(spark):
    questions, chosen, said, picked = _run(spark)
    rows = chosen.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "rank"))).alias("r"), F.first("prompt_status").alias("s")).collect()
    got = {r.query_id: (r.s, [x["rank"] for x in r.r]) for r in rows}
    assert got == {
        0: ("not_applied:no_target_case", list(range(1, 13))), 1: ("applied", [1, 5, 9]), 2: ("applied:user_upload_only", [3, 5]), 3: ("applied:user_upload_with_comparison_authorities", [3, 5, 1, 2, 4]),
        4: ("not_applied:no_case_match", list(range(1, 13))), 5: ("applied", [2, 6, 10]), 6: ("applied", [1, 5, 9]),
    }
    kinds = {r.query_id: (r.context_status, r.n_blocks, r.sentence_limit) for r in picked.collect()}
    assert kinds == {
        0: ("not_applied:no_target_case", 12, 3), 1: ("applied:sentence_evidence", 3, 5), 2: ("applied:user_upload_context", 2, 6), 3: ("applied:user_upload_context", 5, 6),
        4: ("applied:sentence_evidence", 1, 3), 5: ("applied:research_leads", 4, 3), 6: ("not_applied:no_sentence_evidence", 3, 3), 7: ("not_applied:no_prompt_chunks", 0, 5),
    }
    sources = {r.query_id: r.source_chunk_ids for r in picked.collect()}
    assert sources[1] == ["1-9", "1-5", "1-1"] and sources[3] == ["3-3", "3-5", "3-1", "3-2", "3-4"] and sources[7] == []


def test_blocks_of_each_kind(spark):
    questions, chosen, said, picked = _run(spark)
    got = {}
    for r in context.blocks(chosen, picked, questions, said).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append(r.block)
    assert [len(got.get(q, [])) for q in range(8)] == [12, 3, 2, 5, 1, 4, 3, 0]
    assert got[5][0].startswith("Evidence type: research-leads scope constraint") and "Said 9." in got[1][0] and "Text 3." in got[2][0]
