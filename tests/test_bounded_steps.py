"""Steps whose memory or shuffle must not follow the size of a batch or of the corpus."""

import pyarrow as pa

from claimloom import storage
from claimloom.operators import chunking, claims, retrieval
from claimloom.sources import segments


def test_batches_become_python_objects_in_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["x"])
    sizes = [b.num_rows for b in storage.pieces(iter([batch, batch.slice(0, 0)]))]
    assert sum(sizes) == 1000 and max(sizes) == storage.PIECE_ROWS


def test_whole_claims_and_paragraphs_over_several_pieces(spark):
    rows = [(i, None if i % 50 == 0 else f"Part {i} was held.\n\nIt is so.") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((c.doc_id, c.claim_id) for c in claims.decomposed(docs).collect()) == sorted((c["doc_id"], c["claim_id"]) for i, t in rows for c in claims.decompose(str(i), t))
    found = chunking.paragraph_chunks(docs, size=20, overlap=0)
    assert sorted(tuple(r)[2:] for r in found.collect()) == sorted(c for i, t in rows if t for c in ((f"{i}_chunk_0", f"Part {i} was held."), (f"{i}_chunk_1", "It is so.")))


def test_bm25_of_blocks_has_ties_and_packs_of_queries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "SCORED", 8)
    monkeypatch.setattr(retrieval, "TERMS", 3)
    words = ["the", "court", "held", "rule", "tariff", "ship", "salt", "oath"]
    chunks = spark.createDataFrame([(f"c{i:02}", None if i == 5 else " ".join(words[(i * j) % 8] for j in range(1, 2 + i % 6))) for i in range(40)], "chunk_id string, text string").coalesce(1)
    queries = spark.createDataFrame([(i, f"{words[i % 8]} {words[(i * 3) % 8]} the the none{i}") for i in range(20)] + [(99, "nothing here"), (98, None)], "query_id long, text string")
    segments.build(chunks, f"{tmp_path}/index")
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "chunk_id", "score", "rank").collect())
    found = rows(retrieval.bm25_topk(chunks, queries, k=5))
    assert found == rows(segments.search(queries, f"{tmp_path}/index", k=5)) and len(found) == 100
    assert not rows(retrieval.bm25_topk(chunks.limit(0), queries)) and not rows(retrieval.bm25_topk(chunks, queries.limit(0)))


def test_hits_bring_their_own_chunks_alone(spark, tmp_path):
    chunks = spark.createDataFrame([(str(i), f"text {i}") for i in range(50)], "chunk_id string, text string")
    segments.build(chunks, f"{tmp_path}/index")
    hits = spark.createDataFrame([(1, "7"), (2, "7"), (2, "9")], "query_id long, chunk_id string")
    found = segments.chunks_of_hits(hits, f"{tmp_path}/index")
    assert sorted(map(tuple, found.collect())) == [("7", "text 7"), ("9", "text 9")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
