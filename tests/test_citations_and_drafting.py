import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from claimloom.functions import text as tx
from claimloom.operators import citations, claims, drafting, grounding, metrics, retrieval, verification
from claimloom.sources import index, uploads


def _one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_citations_of_a_text(spark):
    got = _one(spark, citations.extracted("t"), t="In Miranda v. Arizona, 384 U.S. 436 (1966), and under 42 U.S.C. § 1983; cf. 12 F. 3d 345.")
    assert [(c.type, c.raw_text, c.case_name, c["at"]) for c in got] == [("case", "384 U.S. 436", "In Miranda v. Arizona", 23), ("statute", "42 U.S.C. § 1983", None, 54), ("case", "12 F.3d 345", "In Miranda v. Arizona", 76)]
    assert _one(spark, citations.extracted("t"), t=None) == [] and _one(spark, citations.extracted("t"), t="none") == []
    many = "See 1 U.S. 2. " * 400
    found = _one(spark, citations.extracted("t"), t=many)
    assert len(found) == 400 and [c["at"] for c in found] == [4 + 14 * i for i in range(400)]


def test_citation_verdicts(spark):
    asked = spark.createDataFrame([(1, "In Smith v. Jones, 410 U.S. 113 (1973), the court held that warnings are required."), (2, "Warnings are required."), (3, "See 9 U.S. 9."), (4, "410 U.S. 113"), (5, "410 U.S. 113 says that fish swim."), (6, None)], "claim_id long, text string")
    chunks = spark.createDataFrame([(7, 1, "410 U.S. 113", "The court held that warnings are required."), (8, 2, None, "Quoted at 410 U. S. 113 in passing."), (9, 3, "1 U.S. 1", None)], "chunk_id long, doc_id long, citation string, text string")
    rows = {r.claim_id: r for r in citations.verify(asked, chunks).collect()}
    assert {k: r.verdict for k, r in rows.items()} == {1: "VERIFIED", 2: "CITATION_ERROR", 3: "CITATION_ERROR", 4: "VERIFIED", 5: "UNSUPPORTED", 6: "CITATION_ERROR"}
    assert rows[1].chunk_id == 7 and rows[1].n_candidates == 2 and rows[1].proposition == "the court held that warnings are required"
    assert rows[2].explanation == "No legal citation found in claim text." and rows[3].explanation == "No retrieved source matches citation 9 U.S. 9."
    assert rows[4].confidence == 1.0 and rows[4].chunk_id == 7
    assert citations.verify(asked.limit(0), chunks).count() == 0 and citations.verify(asked, chunks.limit(0)).where("authority_found").count() == 0


def test_equal_claims_and_chunks_are_rated_once(spark):
    """400 claims on 400 chunks of two texts: 160,000 pairs of rows, two of texts."""
    asked = spark.range(400).selectExpr("id AS claim_id", "'410 U.S. 113 says that fish swim.' AS text")
    chunks = spark.range(400).selectExpr("500 - id AS chunk_id", "id AS doc_id", "'410 U.S. 113' AS citation", "IF(id % 2 = 0, 'It says that fish swim.', 'Nothing.') AS text")
    rated = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda a, b: rated.add(1) or (0.9 if "fish" in b else 0.1), "double").asNondeterministic()
    rows = citations.verify(asked, chunks, score=lambda a, b: seen(a, b)).collect()
    assert len(rows) == 400 and {(r.chunk_id, r.doc_id, r.n_candidates, r.confidence) for r in rows} == {(102, 398, 400, 0.9)}
    assert rated.value <= 8


@pytest.mark.parametrize(("text", "kind"), [("In 410 U.S. courts refused.", "fact"), ("Over 40 us citizens voted.", "fact"), ("It is barred by 28 U.S.C. § 1441(b).", "statutory"), ("See 410 U.S. 113.", "citation"), ("The court held so.", "holding")])
def test_claim_types(spark, text, kind):
    assert _one(spark, claims.claim_type(F.col("t")), t=text) == kind


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("The United States entered the agreement and accepted the terms.", ["The United States entered the agreement.", "The United States accepted the terms."]),
        ("Klein v. Martin says 28 U.S.C. 2254(d) governs habeas review. Harrington v. Richter frames AEDPA review as guarding against extreme malfunctions.", ["Klein v. Martin says 28 U.S.C. 2254(d) governs habeas review.", "Harrington v. Richter frames AEDPA review as guarding against extreme malfunctions."]),
        ("Speech First, Inc. v. Sands requires Speech First to show member injury. The D.C. Circuit addressed causation.", ["Speech First, Inc. v. Sands requires Speech First to show member injury.", "The D.C. Circuit addressed causation."]),
        ("The officer had reasonable suspicion to stop R. W., because fleeing from a traffic stop can indicate danger.", ["The officer had reasonable suspicion to stop R. W.", "Fleeing from a traffic stop can indicate danger."]),
        ("Nor does it change just.", ["Nor does it change just."]),
        ("He left; she stayed", ["He left.", "she stayed."]),
        ("", []),
    ],
)
def test_claims_of_known_texts(text, expected):
    assert [c["text"] for c in claims.decompose("d", text)] == expected


def test_offsets_of_claims():
    text = "One is here. The officer entered the home and arrested Doe."
    rows = claims.decompose("d", text)
    assert [(r["sent_id"], text[r["start_char"] : r["end_char"]]) for r in rows][:2] == [(1, "One is here."), (2, " The officer entered the home")]


def test_premises_are_not_cut_at_abbreviations():
    score = verification.PairScorer()
    premise = "It was argued in the morning. The rule of Smith v. Jones, decided by the U.S. Supreme Court, bars recovery."
    assert score(premise, "The rule of Smith v. Jones, decided by the U.S. Supreme Court, bars recovery.")[0] == 0.96
    assert score(None, None) == (0.05, 0.90, 0.05)


def test_pair_scores_share_their_branches(spark):
    pairs = [("The court granted the motion to dismiss.", "The court never granted the motion to dismiss."), ("Nothing alike stands here at all.", "Fish swim in deep rivers."), ("The court granted relief on appeal today.", "The court granted relief in part on remand.")]
    rows = verification.coverage_scores(spark.createDataFrame(pairs, "p string, h string"), "p", "h").collect()
    for (p, h), r in zip(pairs, rows):
        e, _, c = verification.PairScorer()(p, h)
        assert abs(r.contradiction - c) < 1e-4 and (r.entailment <= e + 1e-4)


def test_a_backend_that_fails_while_it_runs(spark):
    good = spark.createDataFrame([(1, "a:0", 1)], "query_id long, chunk_id string, rank long")
    bad = good.withColumn("rank", F.raise_error(F.lit("down")).cast("long"))
    lists, status = retrieval.hybrid(lambda: good, lambda: bad)
    assert lists.count() == 1 and status.startswith("warning:dense:")
    with pytest.raises(RuntimeError, match="error:dense"):
        retrieval.hybrid(lambda: bad, lambda: bad)


def test_answers_from_evidence(spark):
    s = ["The rule is settled here", "short", "The rule is settled here.", "A second reason is given there", "A third reason is given there", "A fourth one is given there too", "A fifth one is given there too"]
    said = lambda detailed: _one(spark, drafting.fallback_answer(["a", "b"], "s", F.lit(detailed)), a=None, b="tiny", s=s)
    assert said(False) == "The rule is settled here."
    assert said(True) == "The rule is settled here.\n\nA second reason is given there. A third reason is given there.\n\n- A fourth one is given there too.\n- A fifth one is given there too."
    assert _one(spark, drafting.fallback_answer(["a"], "s", F.lit(True)), a=None, s=["no"]) is None


def test_holdings_and_subjects(spark):
    assert _one(spark, drafting.holding_text("t"), t="Syllabus text. Held: The statute does not apply to boats.") == "The statute does not apply to boats."
    assert _one(spark, drafting.holding_text("t"), t="We hold that it stands.") == "We hold that it stands."
    assert _one(spark, drafting.holding_text("t"), t="The weather was fine.") is None and _one(spark, drafting.holding_text("t"), t=None) is None
    assert _one(spark, drafting.absence_subject("t"), t="What is the effective date?") == "an effective date"
    assert _one(spark, drafting.missing_case_answer("a", "c"), a="The rule differs.", c="Roe v. Doe").endswith("related retrieved authorities, the rule differs.")


def test_prompts(spark):
    p = _one(spark, drafting.prompt("q", context="c", history="h", depth="d"), q="What did Roe v. Doe hold?", c=None, h="User: hi", d="detailed")
    assert drafting.NO_CONTEXT in p and "Recent conversation history:\nUser: hi" in p and drafting.TEMPLATES["precision"] in p and p.endswith(drafting.TEMPLATES["detailed"])
    rows = spark.createDataFrame([("a",), (None,)], "prompt string")
    assert [r.answer for r in drafting.generated(rows, lambda ps: [x.upper() for x in ps]).collect()] == ["A", ""]


def test_public_questions(spark):
    yes, no = F.lit(True), F.lit(False)
    ask = lambda m, c, u: _one(spark, drafting.public_question("q", "u", mentions=m, compares=c, sources=F.array(F.lit("northwind_memo.txt"))), q="Compare my uploaded memo on boiler safety", u=u)
    got = ask(yes, yes, ["The expert gave a causation opinion. Northwind boilers burst."])
    assert got.status.startswith("applied") and got.public_query.startswith("Daubert expert testimony") and "boiler" in got.public_query and "northwind" not in got.public_query and got.public_query.endswith("case law precedent")
    assert ask(no, yes, ["x"]).status == "not_applied:no_user_upload_reference" and ask(yes, yes, []).status == "not_applied:no_user_upload_chunks"


def _hits(spark):
    rows = [
        (1, 10, 1, "Roe v. Doe", "410 U.S. 113", "case"), (1, 11, 2, "Other v. Else", None, "case"), (2, 10, 1, "Roe v. Doe", "410 U.S. 113", "case"), (3, 12, 1, "Memo", None, "user_upload"),
        (4, 13, 1, "Kirk v. Spock", None, "case"), (4, 14, 2, "Else v. Other", None, "case"), (5, 15, 1, "Alpha v. Beta", None, "case"), (6, 16, 1, "Gamma v. Delta", None, "case"), (6, 17, 2, "Gamma v. Delta", None, "case"),
    ]
    names = {13: ["kirk", "spock"]}
    shared = {16: ["warp", "drive"], 17: ["warp", "core"]}
    made = [(q, d, r, n, c, t, shared.get(d, names.get(d, ["zzz"])), ["kirk", "phaser"] if q == 4 else [], n) for q, d, r, n, c, t in rows]
    return spark.createDataFrame(made, "query_id long, doc_id long, rank long, case_name string, citation string, doc_type string, name_tokens array<string>, query_tokens array<string>, family string")


def test_resolution_in_order(spark):
    asked = [(1, "What did Roe v. Doe hold?", None, None), (2, "Explain 410 U.S. 113", None, None), (3, "What does it say?", None, None), (4, "what of kirk and the phaser", None, None), (5, "is it so", "off_corpus", 0.9), (6, "anything", None, 0.1), (7, "What did Lost v. Found hold?", None, None), (8, "See 1 U.S. 1", None, None)]
    questions = spark.createDataFrame([(i, q, False, r, c) for i, q, r, c in asked], "query_id long, question string, mentions_upload boolean, route string, confidence double")
    rows = {r.query_id: r for r in grounding.resolve(questions, _hits(spark)).collect()}
    assert {k: r.status for k, r in rows.items()} == {
        1: "resolved:explicit_case", 2: "resolved:citation", 3: "not_resolved:user_upload", 4: "resolved:short_name", 5: "not_resolved:llm_route:off_corpus", 6: "not_resolved:unresolved", 7: "resolved:explicit_case", 8: "not_resolved:citation_unresolved",
    }
    assert rows[1].target_doc_ids == ["10"] and rows[2].target_case == "Roe v. Doe" and rows[4].target_case == "Kirk v. Spock" and rows[7].target_doc_ids == []
    missing = grounding.missing_cases(grounding.resolve(questions, _hits(spark)), _hits(spark)).collect()
    assert [(r.query_id, r.missing_case) for r in missing] == [(7, "Lost v. Found")]


def _docx(*paragraphs):
    body = "".join(f'<w:p><w:r><w:t>{p}</w:t></w:r></w:p>' for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_uploads(spark, tmp_path):
    files = [("u1", "memo one.txt", "﻿Grüße".encode("utf-8"), True), ("u1", "old.txt", "Grüße".encode("cp1252"), None), ("u1", "brief.docx", _docx("First.", " ", "Second."), False), ("u1", "bad.docx", b"no zip", False), ("u2", "run.exe", b"x", False), ("u2", "empty.txt", b"", False), ("u2", None, b"x", False), ("u2", "blank.md", b"  ", False)]
    documents, refused = uploads.taken(spark.createDataFrame(files, "user_id string, name string, content binary, is_privileged boolean"), by=["user_id"])
    rows = {r.source_file: r for r in documents.collect()}
    assert {k: r.full_text for k, r in rows.items()} == {"memo one.txt": "Grüße", "old.txt": "Grüße", "brief.docx": "First.\n\nSecond."}
    assert rows["memo one.txt"].is_privileged and not rows["old.txt"].is_privileged and rows["memo one.txt"].id.startswith("upload_memo-one_")
    assert {r.name: r.reason.split(" ")[0] for r in refused.collect()} == {"bad.docx": "Failed", "run.exe": "Unsupported", "empty.txt": "Uploaded", None: "Uploaded", "blank.md": "Uploaded"}
    path = str(tmp_path / "users")
    uploads.write_index(documents, path)
    own, status = uploads.user_chunks(spark, path, "u1")
    assert status == "ok" and own.count() == 3
    assert uploads.user_chunks(spark, path, "u9") == (None, uploads.NO_INDEX)
    assert uploads.user_chunks(spark, str(tmp_path / "none"), "u1") == (None, uploads.NO_INDEX)


def test_index_artifacts(spark, tmp_path):
    root = str(tmp_path / "ix")
    assert index.discover(spark, root)["source"] == "default:index_dir"
    chunks = spark.createDataFrame([("a:0", "one two two"), ("b:0", "two")], "chunk_id string, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = index.build(chunks, vectors, root)
    assert found["source"] == "summary:index_summary" and spark.read.parquet(found["postings_path"]).where("term = 'two' and tf = 2").count() == 1
    assert index.added(vectors, vectors.where("vec_id = 2").withColumn("embedding", F.array(F.lit(5.0), F.lit(5.0)))).where("vec_id = 2 and embedding[0] = 5").count() == 1
    assert index.removed(vectors, vectors.where("vec_id = 1").select("vec_id")).count() == 1
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "broken_index_summary.json").write_text("{")
    (tmp_path / "other" / "mine_index_summary.json").write_text(json.dumps({"chunks_path": "here", "vectors_path": " "}))
    got = index.discover(spark, str(tmp_path / "other"))
    assert got["chunks_path"].endswith("other/here") and got["vectors_path"].endswith("other/vectors") and got["source"] == "summary:mine_index_summary"
    with pytest.raises(ValueError, match="no chunks"):
        index.build(chunks.limit(0), vectors, str(tmp_path / "none"))


def test_extractive_answers_drop_what_is_alike(spark):
    long = "The court denied the petition of the party on the first day of the term."
    hits = spark.createDataFrame([(1, ["petition", "denied"], 1, f"{long} {long.replace('first', 'First')} The second reason stands on the record of the lower tribunal."), (1, ["petition", "denied"], 2, "short one. and this goes on with the sentence that came before it there.")], "query_id long, query_tokens array<string>, rank long, text string")
    r = metrics.extractive_answers(hits, query="query_id").first()
    assert len(r.sentences) == 2 and r.sentences[0].lower() == long.lower()


def test_metadata_and_let(spark):
    row = spark.createDataFrame([(1, None, [1, 2], True)], "a int, b string, c array<int>, d boolean")
    assert row.select(index.plain_metadata(row.columns, dict(row.dtypes)).alias("m")).first().m == {"a": "1", "c": "[1,2]", "d": "true"}
    assert row.select(tx.let(F.col("a") + 1, lambda x: x * x).alias("v")).first().v == 4
