import json
import os

import pytest
from pyspark.sql import functions as F

from claimloom.operators import metrics
from claimloom.plans import prepare, progress, verify


def _raw(folder, name, rows):
    with open(folder / name, "w") as f:
        f.write("".join(json.dumps({"doc_type": "case", "full_text": t, "id": i, "case_name": f"Case {i}", "title": 4, "date_decided": "2020-01-02"}) + "\n" for i, t in rows))


def _folders(out):
    return {n.removeprefix("output_file="): sorted(os.listdir(out / "chunks" / n)) for n in os.listdir(out / "chunks") if n.startswith("output_file=")}


def test_a_changed_file_replaces_its_own_folder_alone(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    with pytest.raises(ValueError, match="no JSONL"):
        prepare.prepare(spark, str(raw), str(out))
    _raw(raw, "a_cases.jsonl", [("1", "w " * 10), ("2", "x")])
    _raw(raw, "b.jsonl", [("3", "y " * 5), ("4", "  ")])
    run = lambda: {r.name: (r.output_file, r.documents, r.chunks, r.changed) for r in prepare.prepare(spark, str(raw), str(out), size=4, overlap=1).collect()}
    assert run() == {"a_cases.jsonl": ("a_chunks.jsonl", 2, 4, True), "b.jsonl": ("b_chunks.jsonl", 2, 2, True)}
    assert prepare.summary(spark, str(out))["chunks_written"] == 6 and prepare.summary(spark, str(out))["documents_loaded"] == 4
    first = _folders(out)
    assert run()["b.jsonl"] == ("b_chunks.jsonl", 2, 2, False) and _folders(out) == first
    _raw(raw, "b.jsonl", [("3", "y " * 9)])
    os.utime(raw / "b.jsonl", (2_000_000_000, 2_000_000_000))
    assert run() == {"a_cases.jsonl": ("a_chunks.jsonl", 2, 4, False), "b.jsonl": ("b_chunks.jsonl", 1, 3, True)}
    assert _folders(out)["a_chunks.jsonl"] == first["a_chunks.jsonl"] and _folders(out)["b_chunks.jsonl"] != first["b_chunks.jsonl"]
    chunks = prepare.load_chunks(spark, str(out))
    assert {(r.id, r.case_name, r.title, str(r.date_decided)) for r in chunks.collect()} == {(i, f"Case {i}", 4, "2020-01-02") for i in "123"}
    (raw / "a_cases.jsonl").unlink()
    assert set(run()) == {"b.jsonl"} and set(_folders(out)) == {"b_chunks.jsonl"}
    assert prepare.summary(spark, str(out))["output_file"] == "b_chunks.jsonl"


def test_observed_stages_have_the_counts_of_plain_runs(spark):
    docs = spark.createDataFrame([(i, f"the court held that river {i} is a boundary of the state", "scotus", "case") for i in range(12)], "doc_id long, text string, court_level string, doc_type string")
    asked = spark.createDataFrame([("c1", "river 3 is a boundary"), ("c2", "nothing shared zzz")], "claim_id string, text string")
    seen = progress.Progress()
    out = verify.verify_claims(docs, asked, k=4, progress=seen)
    assert {r["stage"]: r["state"] for r in seen.rows()}["verdicts"] == "open"
    assert len(out.collect()) == 2
    known = {r["stage"]: (r["state"], r["rows"]) for r in seen.rows()}
    assert known["retrieval"] == ("done", 4) and known["pair_scores"] == ("done", 4) and known["verdicts"] == ("done", 2)


def test_answers_in_the_words_of_the_court_and_for_every_question(spark):
    assert metrics.said_as_answer("Held: The rule applies.") == "The Court held that the rule applies."
    assert metrics.said_as_answer("(A) Pp. 3–4. The rule applies.") == "The rule applies."
    assert metrics.said_as_answer("Held:") == "Held:"
    same = ["Held: The statute applies to every agency of the state.", "held the statute applies to every agency of the state", "Another rule governs the federal courts alone."]
    assert metrics.unlike(same, 3) == ["The Court held that the statute applies to every agency of the state.", same[2]]
    hits = spark.createDataFrame([(1, 1, "Too short. x"), (1, 2, "no"), (2, 1, "The statute applies to every agency of the federal state today.")], "query_id long, rank int, text string").withColumn("query_tokens", F.array(F.lit("statute")))
    got = {r.query_id: r.answer for r in metrics.extractive_answers(hits, query="query_id").collect()}
    assert got == {1: "Too short. x.", 2: "The statute applies to every agency of the federal state today."}
