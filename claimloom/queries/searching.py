"""Queries on sparse and dense retrieval and fusion."""

from pyspark.sql import functions as F

from .. import config
from ..operators import chunking, retrieval
from ..sources import segments, versions
from ..sources import vectors as lists
from ..storage import new_folder, written
from . import query, table

WORDS = r"list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')"
CHUNKS = f"""w AS (SELECT doc_id, {WORDS} AS w FROM documents),
    i AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) > 512 THEN CAST(ceil((len(w) - 512) / 448.0) AS BIGINT) ELSE 0 END + 1)) AS i FROM w WHERE len(w) > 0),
    chunks AS (SELECT doc_id, i AS chunk_index, doc_id || ':' || i AS chunk_id, array_to_string(w[i * 448 + 1:i * 448 + 512], ' ') AS text FROM i),
    tok AS (SELECT chunk_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda t: lower(t)) AS t FROM chunks),
    post AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
    st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
    idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, st GROUP BY term)"""
BM25 = f"""{CHUNKS},
    q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS term FROM benchmark) GROUP BY ALL),
    sc AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN post USING (term) JOIN idf USING (term), st GROUP BY ALL),
    bm AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 20)"""
DENSE = """nv AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    u AS (SELECT vec_id, list_transform(v, lambda x: x / CASE WHEN list_sum(list_transform(v, lambda y: y * y)) = 0 THEN 1 ELSE sqrt(list_sum(list_transform(v, lambda y: y * y))) END) AS v FROM nv),
    de AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 6) AS score
        FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    dt AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM de QUALIFY rank <= 20)"""


def chunks_of(spark, sf_dir):
    return chunking.word_windows(table(spark, sf_dir, "documents"))


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_INDEXES: dict[tuple, str] = {}


def index_of(spark, sf_dir):
    """Folder of the index over the word windows of all documents: built once for a session and a set of files."""
    files = (spark.sparkContext.applicationId, *sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").inputFiles()))
    if files not in _INDEXES or not versions.latest(spark, _INDEXES[files]):  # a swept folder is built again
        path = new_folder(spark, "index")
        segments.build(chunks_of(spark, sf_dir), path)
        _INDEXES[files] = path
    return _INDEXES[files]


def indexed_chunks(spark, sf_dir):
    """The same rows as ``chunks_of``, read from the index."""
    return segments.live_chunks(spark, index_of(spark, sf_dir))


def bm25(spark, sf_dir, k=config.SPARSE_K):
    """The hits, written: most users read them more than once."""
    return written(segments.search(asked(spark, sf_dir), index_of(spark, sf_dir), k=k), "bm25-hits")


def hit_chunks(spark, sf_dir, hits):
    """The chunks of hits alone."""
    return segments.chunks_of_hits(hits, index_of(spark, sf_dir))


def dense(spark, sf_dir, k=config.DENSE_K):
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.dense_topk(vectors, vectors.where("vec_id % 20 = 0"), k=k)


@query(f"WITH {CHUNKS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def term_stats(spark, sf_dir):
    path = index_of(spark, sf_dir)
    n, _ = segments.statistics(spark, path)
    df = F.col("df")
    return segments.document_frequencies(spark, path).select("term", "df", F.round(F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5)), 6).alias("idf"))


@query(f"WITH {CHUNKS} SELECT chunk_id, CAST(len(t) AS BIGINT) AS dl, round(len(t) / avgdl, 6) AS relative FROM tok, st")
def doc_stats(spark, sf_dir):
    stats = retrieval.doc_stats(chunks_of(spark, sf_dir))
    return stats.crossJoin(F.broadcast(stats.agg(F.avg("dl").alias("avgdl")))).select("chunk_id", "dl", F.round(F.col("dl") / F.col("avgdl"), 6).alias("relative"))


@query(f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM bm")
def bm25_topk(spark, sf_dir):
    """Without an index: the chunks are read for these questions alone."""
    return retrieval.bm25_topk(chunks_of(spark, sf_dir), asked(spark, sf_dir)).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM bm")
def bm25_indexed(spark, sf_dir):
    return bm25(spark, sf_dir)


@query("WITH " + BM25.replace("FROM documents)", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))", 1) + " SELECT query_id, chunk_id, score, rank FROM bm")
def bm25_after_changes(spark, sf_dir):
    """An index of three segments: English and French documents, the others and again the French ones, and toxic ones taken out."""
    docs = table(spark, sf_dir, "documents")
    first = F.coalesce(F.col("lang").isin("en", "fr"), F.lit(False))
    path = new_folder(spark, "changed-index")
    segments.build(chunking.word_windows(docs.where(first)), path)
    segments.add(chunking.word_windows(docs.where(~first | F.coalesce(F.col("lang") == "fr", F.lit(False)))), path)
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    segments.delete(segments.live_chunks(spark, path).join(toxic, "doc_id", "left_semi").select("chunk_id"), path)
    return segments.search(asked(spark, sf_dir), path)


@query(f"WITH {DENSE} SELECT query_id, vec_id, score, rank FROM dt")
def dense_topk(spark, sf_dir):
    return dense(spark, sf_dir).select("query_id", "vec_id", "score", "rank")


def _by_lists(spark, sf_dir, probed):
    vectors, path = table(spark, sf_dir, "embeddings"), new_folder(spark, "lists")
    lists.build(vectors, path)
    return lists.search(vectors.where("vec_id % 20 = 0"), path, probed=probed).select("query_id", "vec_id", "score", "rank")


@query(f"WITH {DENSE} SELECT query_id, vec_id, score, rank FROM dt")
def dense_by_lists(spark, sf_dir):
    """The index with all lists probed: the exact rows."""
    return _by_lists(spark, sf_dir, 1.0)


@query()
def ann_topk(spark, sf_dir):
    """Approximate, so without SQL; its recall is tested against ``dense_topk``."""
    return _by_lists(spark, sf_dir, lists.PROBED)


@query(f"WITH {DENSE} SELECT vec_id, round(v[1], 6) AS first, round(v[64], 6) AS last, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm FROM u")
def l2_normalize(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", retrieval.normalized("embedding").alias("v"))
    return v.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"), F.round(retrieval.dot("v", "v"), 6).alias("norm"))


LISTS = f"""{BM25}, {DENSE},
    lists AS (SELECT query_id, chunk_id, rank FROM bm UNION ALL SELECT CAST(query_id / 20 AS BIGINT), vec_id || ':0', rank FROM dt),
    fu AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, min(rank) AS best_rank FROM lists GROUP BY ALL),
    fr AS (SELECT query_id, chunk_id, rrf, best_rank, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best_rank, chunk_id) AS fused_rank FROM fu QUALIFY fused_rank <= 10)"""


def fused(spark, sf_dir):
    """Query 20 i of the vectors goes with query i of the texts, vector i with the first chunk of document i.

    The rows have no place for a status, so a search that fails fails the query: the other list alone would look like a result.
    """
    d = dense(spark, sf_dir).select((F.col("query_id") / 20).cast("long").alias("query_id"), F.concat(F.col("vec_id").cast("string"), F.lit(":0")).alias("chunk_id"), "rank")
    lists, _ = retrieval.hybrid(lambda: bm25(spark, sf_dir), lambda: d, whole=True)
    return retrieval.fuse(lists)


@query(f"WITH {LISTS} SELECT query_id, chunk_id, rrf, best_rank, fused_rank FROM fr")
def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("query_id", "chunk_id", "rrf", "best_rank", "fused_rank")


@query(f"""WITH {LISTS} SELECT query_id, chunk_id AS id, rrf AS rrf_score, coalesce(sha1(text), 'N/A') AS digest, coalesce(source, 'API Corpus') AS source, 'N/A' AS citation
    FROM fr LEFT JOIN chunks USING (chunk_id) LEFT JOIN documents d USING (doc_id)""".replace("sha1(text)", "sha1(chunks.text)"))
def hybrid_projection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    hits = written(fused(spark, sf_dir), "fused")
    text = hit_chunks(spark, sf_dir, hits).select("chunk_id", "doc_id", F.sha1("text").alias("digest"))
    return (
        hits.join(text, "chunk_id", "left").join(docs, "doc_id", "left")
        .select("query_id", F.col("chunk_id").alias("id"), F.col("rrf").alias("rrf_score"), F.coalesce("digest", F.lit("N/A")).alias("digest"), F.coalesce("source", F.lit("API Corpus")).alias("source"), F.lit("N/A").alias("citation"))
    )


@query("""WITH h AS (SELECT doc_id, 1 AS ord, CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE source END AS source, NULL AS lang FROM documents
        UNION ALL SELECT doc_id, 2, source || '-b', lang FROM documents)
    SELECT doc_id, min_by(source, ord) FILTER (trim(coalesce(source, '')) <> '') AS source, min_by(lang, ord) FILTER (trim(coalesce(lang, '')) <> '') AS lang FROM h GROUP BY doc_id""")
def metadata_backfill(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = docs.select("doc_id", F.lit(1).alias("ord"), F.when(F.col("doc_id") % 2 == 0, "  ").otherwise(F.col("source")).alias("source"), F.lit(None).cast("string").alias("lang"))
    later = docs.select("doc_id", F.lit(2).alias("ord"), F.concat("source", F.lit("-b")).alias("source"), "lang")
    return retrieval.backfilled(first.unionByName(later), ["doc_id"], ["source", "lang"], "ord")


@query(f"""WITH {BM25},
    m AS (SELECT query_id, chunk_id, 0 AS priority, rank FROM bm WHERE chunk_id LIKE '%:1' UNION ALL SELECT query_id, chunk_id, 1, rank FROM bm WHERE rank % 3 = 0 UNION ALL SELECT query_id, chunk_id, 2, rank FROM bm),
    o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY priority, rank) = 1)
    SELECT query_id, chunk_id, priority, row_number() OVER (PARTITION BY query_id ORDER BY priority, rank, chunk_id) AS position FROM o QUALIFY position <= 8""")
def priority_merge(spark, sf_dir):
    hits = bm25(spark, sf_dir).select("query_id", "chunk_id", F.col("rank").alias("ord"))
    merged = retrieval.merge_by_priority([hits.where("chunk_id like '%:1'"), hits.where("ord % 3 = 0"), hits], query="query_id", key="chunk_id", order="ord")
    return merged.select("query_id", "chunk_id", "priority", "position")


@query(f"""WITH {LISTS}, rs AS (SELECT query_id, chunk_id, fused_rank, CASE WHEN fused_rank % 2 = 0 THEN 1.0 ELSE 0.5 END AS s FROM fr)
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, fused_rank) AS reranked FROM rs QUALIFY reranked <= 5""")
def rerank_stable(spark, sf_dir):
    score = F.when(F.col("fused_rank") % 2 == 0, 1.0).otherwise(0.5)
    return retrieval.rerank(fused(spark, sf_dir), score, query="query_id", k=5).select("query_id", "chunk_id", "reranked")


@query(f"""WITH {CHUNKS}, c AS (SELECT chunk_id, doc_id, chunk_index, lower('Party ' || doc_id || ' v. ' || source) AS n FROM chunks JOIN documents USING (doc_id)),
    k AS (SELECT *, regexp_replace(n, '[^a-z0-9]+', '', 'g') AS name_key FROM c),
    t AS (SELECT item_id AS query_id, 'party' || item_id || 'v' AS target_key FROM benchmark)
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, chunk_index, chunk_id) AS rank
    FROM k JOIN t ON contains(name_key, target_key) OR contains(target_key, name_key) QUALIFY rank <= 40""".replace("SELECT chunk_id, doc_id, chunk_index, lower", "SELECT chunk_id, chunks.doc_id, chunk_index, lower").replace("'Party ' || doc_id", "'Party ' || chunks.doc_id"))
def target_metadata_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Party "), F.col("doc_id").cast("string"), F.lit(" v. "), "source").alias("case_name"))
    chunks = chunks_of(spark, sf_dir).drop("text").join(docs, "doc_id")
    targets = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("Party "), F.col("item_id").cast("string"), F.lit(" v.")).alias("target"))
    return retrieval.target_chunks(chunks, targets).select("query_id", "chunk_id", "rank")
