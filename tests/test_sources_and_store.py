import json
import urllib.error

from pyspark.sql import functions as F

from claimloom.operators import store
from claimloom.sources import ingest, paged, pages
from claimloom.streaming import incremental


def test_latest_version_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "id string, version long, value string")
    got = {r.id: (r.value, r.first_seen) for r in ingest.latest(rows, "id", "version").collect()}
    assert got == {"a": ("z", 1), "b": ("y", 2)}


def test_read_documents(spark, tmp_path):
    (tmp_path / "a_cases.jsonl").write_text(json.dumps({"id": "1", "doc_type": "case", "full_text": "x", "date_decided": "2026-03-01"}) + "\n" + json.dumps({"id": "2", "doc_type": "case", "full_text": "y", "date_decided": "no"}) + "\n")
    rows = {r.id: r for r in ingest.read_documents(spark, str(tmp_path)).collect()}
    assert str(rows["1"].date_decided) == "2026-03-01" and rows["2"].date_decided is None and rows["2"].is_privileged is False


def test_pages_follow_links_and_wait():
    answers = {"u": {"results": [1, 2], "next": "v"}, "v": {"results": [3], "next": None}}
    failed, slept = [], []

    def get(url):
        if url == "v" and not failed:
            failed.append(1)
            raise urllib.error.HTTPError(url, 429, "", {"Retry-After": "7"}, None)
        return answers[url]

    assert list(paged.pages(get, "u", sleep=slept.append, clock=lambda: 0.0)) == [1, 2, 3]
    assert slept == [paged.PACE_S, 7.0]


def test_page_text(spark):
    rows = [("d", p, f"ACME REPORT\nThis is line one of page {p}\nwhich goes on.\n{p}") for p in range(1, 5)]
    r = pages.assemble(spark.createDataFrame(rows, "doc string, page int, text string"), doc="doc", page="page").first()
    assert "ACME REPORT" not in r.text and "This is line one of page 2 which goes on." in r.text


def test_uploads(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "my_brief.md").write_text("  Some text.\n")
    (tmp_path / "empty.txt").write_text("  ")
    (tmp_path / "no.pdf").write_text("x")
    rows = pages.read_uploads(spark, str(tmp_path)).collect()
    assert [(r.source_file, r.case_name, r.text) for r in rows] == [("my_brief.md", "my brief", "Some text.")]


def test_stream_upserts_once(spark, tmp_path):
    raw, table = tmp_path / "raw", tmp_path / "table"
    raw.mkdir()
    line = lambda i, t: json.dumps({"id": i, "full_text": t}) + "\n"
    (raw / "a.jsonl").write_text(line("1", "old") + line("2", "b"))
    for _ in range(2):
        incremental.sync(incremental.documents(spark, str(raw)), str(table), str(tmp_path / "check")).awaitTermination()
    (raw / "b.jsonl").write_text(line("1", "new"))
    incremental.sync(incremental.documents(spark, str(raw)), str(table), str(tmp_path / "check")).awaitTermination()
    assert {r.id: r.full_text for r in incremental.current(spark, str(table)).collect()} == {"1": "new", "2": "b"}


def test_upsert_keeps_old_values(spark):
    old = spark.createDataFrame([(1, "s", "{}"), (2, "t", "{}")], "id long, summary string, state string")
    new = spark.createDataFrame([(1, "u", None), (3, "v", "x")], "id long, summary string, state string")
    got = {r.id: (r.summary, r.state) for r in store.upsert(old, new, key="id", keep_old=("state",)).collect()}
    assert got == {1: ("u", "{}"), 2: ("t", "{}"), 3: ("v", "x")}


def test_cascade(spark):
    tables = {
        "users": spark.range(2),
        "conversations": spark.createDataFrame([(10, 0), (11, 1)], "id long, user_id long"),
        "messages": spark.createDataFrame([(1, 10), (2, 11), (3, 10)], "id long, conversation_id long"),
    }
    left = store.without(tables, "users", spark.createDataFrame([(0,)], "id long"))
    assert [r.id for r in left["conversations"].collect()] == [11] and [r.id for r in left["messages"].collect()] == [2]


def test_missing_columns_are_null(spark):
    r = store.conform(spark.createDataFrame([(1, "x")], "id long, claim_text string"), "verified_claims").first()
    assert r.claim_text == "x" and r.metadata_json is None


def test_unreadable_state_is_empty(spark):
    rows = spark.createDataFrame([("{bad",), (None,), ('{"a": 1}',)], "j string")
    assert [r.s.a for r in rows.select(store.state_json("j", "a long").alias("s")).collect()] == [None, None, 1]


def test_best_text(spark):
    rows = spark.createDataFrame([(" ", "<p>x &amp; y</p>"), ("plain", "<p>z</p>"), (None, None)], "plain_text string, html string")
    assert [r.t for r in rows.select(ingest.opinion_text({"plain_text": False, "html": True}).alias("t")).collect()] == ["x & y", "plain", None]
    assert rows.select(F.lit(1)).count() == 3
