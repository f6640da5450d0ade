"""Queries on the choice of prompt chunks and of contexts."""

from pyspark.sql import functions as F

from ..operators import context, posture
from . import query, searching, table

_COMPARED = posture.COMPARING.replace("'", "''")
#: Question i asks for a comparison, names a case, wants leads or detail by its number; every 40th document is an upload.
_SET = f"""{searching.BM25},
    qs AS (SELECT item_id AS query_id, text || CASE WHEN item_id % 4 = 0 THEN ' Compare the precedent.' ELSE '' END AS question, item_id % 5 = 1 AS leads, CASE WHEN item_id % 2 = 0 THEN 'detailed' ELSE 'concise' END AS depth,
        item_id % 3 <> 0 AS named FROM benchmark),
    h AS (SELECT bm.query_id, bm.chunk_id, rank, c.doc_id, CASE WHEN c.doc_id % 40 = 0 THEN 'user_upload' ELSE 'case' END AS doc_type FROM bm JOIN chunks c USING (chunk_id)),
    target AS (SELECT query_id, doc_id AS target_doc FROM h JOIN qs USING (query_id) WHERE named AND rank = 2),
    m AS (SELECT h.*, question, leads, depth, target_doc, doc_type = 'user_upload' AS up, coalesce(h.doc_id = target_doc, false) AS own, max(doc_type = 'user_upload') OVER w AS ups, max(coalesce(h.doc_id = target_doc, false)) OVER w AS owns, regexp_matches(question, '{_COMPARED}') AS compared
        FROM h JOIN qs USING (query_id) LEFT JOIN target t USING (query_id) WINDOW w AS (PARTITION BY h.query_id)),
    s AS (SELECT *, CASE WHEN ups AND compared THEN 'applied:user_upload_with_comparison_authorities' WHEN ups THEN 'applied:user_upload_only' WHEN target_doc IS NULL THEN 'not_applied:no_target_case' WHEN NOT owns THEN 'not_applied:no_case_match' ELSE 'applied' END AS prompt_status,
        CASE WHEN ups AND NOT up THEN 1 ELSE 0 END AS g FROM m),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY rank, chunk_id) AS inside, row_number() OVER (PARTITION BY query_id ORDER BY g, rank, chunk_id) AS place FROM s
        WHERE CASE WHEN ups THEN up OR compared WHEN prompt_status = 'applied' THEN own ELSE true END),
    chosen AS (SELECT * FROM o WHERE CASE WHEN g = 1 THEN inside <= 3 WHEN prompt_status = 'applied' THEN inside <= 8 ELSE true END)"""


def _questions(spark, sf_dir):
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        i.alias("query_id"), F.concat("text", F.when(i % 4 == 0, " Compare the precedent.").otherwise("")).alias("question"), (i % 5 == 1).alias("leads"),
        F.when(i % 2 == 0, "detailed").otherwise("concise").alias("depth"), (i % 3 != 0).alias("named"),
    )


def _chosen(spark, sf_dir):
    """(questions with their target, chosen hits): the target is the document of a question's second hit."""
    hits = searching.bm25(spark, sf_dir)
    hits = hits.join(searching.hit_chunks(spark, sf_dir, hits).select("chunk_id", "doc_id", "text"), "chunk_id")
    hits = hits.select("query_id", "chunk_id", "rank", "doc_id", "text", F.when(F.col("doc_id") % 40 == 0, "user_upload").otherwise("case").alias("doc_type"), F.concat(F.lit("Party n"), F.col("doc_id").cast("string"), F.lit("n v. State")).alias("case_name"))
    questions = _questions(spark, sf_dir).join(hits.where("rank = 2").select("query_id", F.col("case_name").alias("second")), "query_id", "left")
    questions = questions.withColumns({"target_case": F.when(F.col("named"), F.col("second")), "target_doc_ids": F.lit(None).cast("array<long>")})
    return questions, context.prompt_chunks(hits, questions)


@query(f"WITH {_SET} SELECT query_id, place, chunk_id, prompt_status FROM chosen")
def prompt_selection(spark, sf_dir):
    return _chosen(spark, sf_dir)[1].select("query_id", "place", "chunk_id", "prompt_status")


@query(f"""WITH {_SET}, c AS (SELECT query_id, count(*) AS n, bool_or(up) AS up, string_agg(chunk_id, ',' ORDER BY place) AS own FROM chosen GROUP BY query_id),
    l AS (SELECT qs.*, n, coalesce(up, false) AS up, own, CASE WHEN up THEN 6 WHEN depth = 'detailed' THEN 5 ELSE 3 END AS lim, target_doc FROM qs LEFT JOIN c USING (query_id) LEFT JOIN target USING (query_id)),
    se AS (SELECT query_id, count(*) AS n_said, string_agg(chunk_id, ',' ORDER BY rank) AS said FROM chosen JOIN l USING (query_id) WHERE query_id % 7 <> 0 AND rank <= lim GROUP BY query_id),
    z AS (SELECT l.*, n_said, said, CASE WHEN n IS NULL THEN 'not_applied:no_prompt_chunks' WHEN up THEN 'applied:user_upload_context' WHEN leads THEN 'applied:research_leads' WHEN target_doc IS NULL THEN 'not_applied:no_target_case' WHEN n_said IS NULL THEN 'not_applied:no_sentence_evidence' ELSE 'applied:sentence_evidence' END AS context_status FROM l LEFT JOIN se USING (query_id))
    SELECT query_id, context_status, CAST(CASE WHEN n IS NULL THEN 0 WHEN context_status = 'applied:sentence_evidence' THEN n_said WHEN context_status = 'applied:research_leads' THEN n + 1 ELSE n END AS BIGINT) AS n_blocks, CAST(lim AS BIGINT) AS sentence_limit,
        coalesce(CASE WHEN context_status = 'applied:sentence_evidence' THEN said ELSE own END, '') AS sources FROM z""")
def context_choice(spark, sf_dir):
    """The first sentence of a hit stands for its evidence; every seventh question has none."""
    questions, chosen = _chosen(spark, sf_dir)
    sentences = chosen.where("query_id % 7 <> 0").select("query_id", "rank", "chunk_id")
    picked = context.choice(chosen, questions, sentences)
    return picked.select("query_id", "context_status", "n_blocks", "sentence_limit", F.array_join("source_chunk_ids", ",").alias("sources"))
