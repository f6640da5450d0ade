import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimloom.operators import citations, containment, retrieval
from claimloom.sources import segments, versions

SCHEMA = "chunk_id string, text string"


def _bm25(chunks, queries, k):
    """Plain BM25 over live chunks, as {query: [(chunk, score)]}."""
    toks = {c: [t.lower() for t in re.findall("[A-Za-z0-9_]+", x or "")] for c, x in chunks.items()}
    n, avg = len(toks), (sum(map(len, toks.values())) / len(toks) if toks else 0) or 1
    df = Counter(t for x in toks.values() for t in set(x))
    out = {}
    for q, text in queries:
        rows = []
        for c, x in toks.items():
            tf = Counter(x)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t in re.findall("[a-z0-9_]+", text.lower()) if tf[t])
            if round(s, 6) > 0:
                rows.append((c, round(s, 6)))
        out[q] = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
    return {q: r for q, r in out.items() if r}


def _texts(seed, n, words=120):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return {f"c{i}": " ".join(rng.choices(names, weights, k=rng.randint(0, 40))) for i in range(n)}


def _same(spark, path, live, k=5):
    queries = [(0, "w0 w1 w0"), (1, "w50 w3"), (2, "W77"), (3, "nothing"), (4, ""), (5, "w110 w111 w2 w2")]
    got = {}
    for r in segments.search(spark.createDataFrame(queries, "query_id long, text string"), path, k=k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    want = _bm25(live, queries, k)
    assert {q: [c for c, _ in r] for q, r in got.items()} == {q: [c for c, _ in r] for q, r in want.items()}
    for q in got:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)


def _frame(spark, chunks):
    return spark.createDataFrame(list(chunks.items()), SCHEMA).repartition(3)


def test_segments_equal_a_rebuilt_index(spark, tmp_path):
    path, live = str(tmp_path / "i"), _texts(1, 90)
    segments.build(_frame(spark, live), path, block=8)
    _same(spark, path, live)
    more = _texts(2, 110)  # c0 to c89 come again with other texts
    more["null"] = None
    segments.add(_frame(spark, more), path)
    live |= more
    _same(spark, path, live)
    gone = [f"c{i}" for i in range(0, 110, 3)] + ["unknown"]
    segments.delete(spark.createDataFrame([(g,) for g in gone], "chunk_id string"), path)
    live = {c: t for c, t in live.items() if c not in gone}
    _same(spark, path, live)
    back = {"c3": "w110 w111", "many": "w3 " * 700}  # a deleted id comes back; a count that takes more than a byte
    segments.add(_frame(spark, back), path)
    live |= back
    _same(spark, path, live)
    n, average = segments.statistics(spark, path)
    lengths = [len(re.findall(r"\w+", t or "")) for t in live.values()]
    assert n == len(live) and average == pytest.approx(sum(lengths) / n)
    before = {r.term: r.df for r in segments.document_frequencies(spark, path).collect()}
    assert before == Counter(t for x in live.values() for t in set((x or "").split()))
    assert segments.delete(spark.createDataFrame([("never",)], "chunk_id string"), path)["segments"] == versions.latest(spark, path)["segments"]
    segments.compact(spark, path)
    assert len(versions.latest(spark, path)["segments"]) == 1
    assert {r.chunk_id: r.text for r in segments.live_chunks(spark, path).collect()} == live
    assert {r.term: r.df for r in segments.document_frequencies(spark, path).collect()} == before
    _same(spark, path, live)


def test_blocks_are_skipped_without_loss(spark, tmp_path, monkeypatch):
    live = {f"c{i:03d}": "common filler" + " rare" * (i in (5, 170)) + " word" * (i % 7) for i in range(200)}
    path = str(tmp_path / "i")
    segments.build(spark.createDataFrame(sorted(live.items()), SCHEMA).coalesce(1), path, block=8)
    seen, keep = [], segments._open

    def noted(bounds, *rest):
        seen.extend([bounds.count(), keep(bounds, *rest).count()])
        return keep(bounds, *rest)

    monkeypatch.setattr(segments, "_open", noted)
    queries = spark.createDataFrame([(0, "rare common")], "query_id long, text string")
    hits = segments.search(queries, path, k=2)
    assert [r.chunk_id for r in hits.orderBy("rank").collect()] == [c for c, _ in _bm25(live, [(0, "rare common")], 2)[0]]
    assert seen == [25, 0]  # all blocks hold "common"; the two with "rare" come first, and no other can reach them


def test_only_folders_of_asked_terms_are_read(spark, tmp_path):
    path = str(tmp_path / "i")
    segments.build(_frame(spark, _texts(3, 60)), path)
    asked = spark.createDataFrame([("w1",), ("w2",)], "term string")
    manifest = versions.latest(spark, path)
    buckets = {r[0] for r in asked.select(segments.bucket_of("term", manifest["buckets"])).collect()}
    df = segments._of_terms(segments._postings(spark, path, manifest["segments"]), asked, list(buckets), 2)
    files = df.select(F.input_file_name()).distinct().collect()
    assert {int(re.search(r"bucket=(-?\d+)", r[0])[1]) for r in files} <= buckets


def test_empty_index_and_bad_ids(spark, tmp_path):
    path = str(tmp_path / "i")
    none = spark.createDataFrame([], SCHEMA)
    segments.build(none, path)
    queries = spark.createDataFrame([(0, "a")], "query_id long, text string")
    assert segments.search(queries, path).count() == 0
    assert segments.live_chunks(spark, path).count() == 0
    segments.add(spark.createDataFrame([("x", "a b"), ("y", "")], SCHEMA), path)
    assert [r.chunk_id for r in segments.search(queries, path).collect()] == ["x"]
    for rows in ([("z", "a"), ("z", "b")], [(None, "a")]):
        with pytest.raises(ValueError, match="unique"):
            segments.add(spark.createDataFrame(rows, SCHEMA), path)
    with pytest.raises(ValueError, match="already"):
        segments.build(none, path)


def test_a_lost_race_is_a_conflict_and_is_retried(spark, tmp_path):
    path = str(tmp_path / "v")
    first = versions.commit(spark, path, None, {"n": 0})
    assert versions.latest(spark, path) == first
    versions.commit(spark, path, first, {"n": 1})
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, first, {"n": 2})
    calls = []

    def change():
        now = versions.latest(spark, path)
        if not calls:
            versions.commit(spark, path, now, {"n": now["n"] + 10})  # another writer
        calls.append(1)
        return versions.commit(spark, path, now, {"n": now["n"] + 100})

    assert versions.retried(change)["n"] == 111 and len(calls) == 2
    assert [versions.claim_number(spark, f"{path}/ids") for _ in range(3)] == [0, 1, 2]


def test_contained_equals_brute_force(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choices("ab1", k=n))
    texts = [(i, make(rng.choice([0, 1, 5, 30, 200]))) for i in range(80)] + [(900, None), (901, "déjà vu ab1"), (902, "ab1")]
    keys = [make(rng.choice([1, 2, 3, 7, 8, 9, 12, 20])) for _ in range(60)] + [texts[20][1][3:25], "", None, "ab1", "à", "zzz"]
    got = containment.contained(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame([(k,) for k in keys], "key string"))
    want = sorted({(i, k) for i, t in texts for k in keys if k and k.isascii() and t and k in t})
    assert sorted((r.text_id, r.key) for r in got.collect()) == want
    assert containment.contained(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame([("",)], "key string")).count() == 0


def test_no_nested_loops_over_names_and_citations(spark):
    chunks = spark.createDataFrame([("a:0", 1, 0, "Smith v. Jones", "102 U.S. 1", "see 410 U.S. 113 here"), ("b:0", 2, 0, "Doe", None, "x")], "chunk_id string, doc_id long, chunk_index long, case_name string, citation string, text string")
    targets = spark.createDataFrame([(0, "Smith v Jones III"), (1, "doe"), (2, None)], "query_id long, target string")
    asked = spark.createDataFrame([("102US1",), ("410US113",), ("",)], "citation_key string")
    named, cited = retrieval.target_chunks(chunks, targets), citations.candidates(asked, chunks)
    for df in (named, cited):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted((r.query_id, r.chunk_id) for r in named.collect()) == [(0, "a:0"), (1, "b:0")]
    assert sorted((r.citation_key, r.chunk_id) for r in cited.collect()) == [("102US1", "a:0"), ("410US113", "a:0")]


def test_dense_rows_of_unlike_width(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [2.0]), (2, [0.5, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, []), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = retrieval.dense_topk(vectors, vectors.where("vec_id = 0"), k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (2, 1.0), (3, 0.0)]
