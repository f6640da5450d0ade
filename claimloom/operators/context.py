"""What a generator gets to see: the choice of chunks and of the kind of context, for a batch of questions.

Both choices are made by windows over the hits of a question, so all questions
of a batch go through one plan and no hits are gathered for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names
from . import drafting, posture

# Most chunks of a target case, public chunks beside uploads, and sentences by depth and for uploads.
TARGET_CHUNKS, COMPARED_CHUNKS = 8, 3
SENTENCES, DETAILED_SENTENCES, UPLOAD_SENTENCES = 3, 5, 6


def prompt_chunks(hits: DataFrame, questions: DataFrame, *, query: str = "query_id") -> DataFrame:
    """The hits of each question that go into its prompt, with ``place`` and ``prompt_status``.

    ``hits``: query, chunk_id, doc_id, rank, doc_type, case_name, .. ``questions``:
    query, question, target_case, target_doc_ids (array or null). Where uploads
    were found they stand alone, unless a comparison is asked for; else the
    chunks of the target's documents, if any; else all hits.
    """
    all_hits = W.partitionBy(query)
    rows = hits.join(questions.select(query, "question", "target_case", "target_doc_ids"), query)
    upload = F.coalesce(F.col("doc_type") == "user_upload", F.lit(False))
    own = F.coalesce(names.names_match(names.case_key("target_case"), names.case_key("case_name")), F.lit(False))
    rows = rows.withColumns({"upload_": upload, "own_": own})
    of_doc = F.coalesce(F.max("own_").over(W.partitionBy(query, "doc_id")) & F.col("doc_id").isNotNull(), F.lit(False))
    listed = F.coalesce(F.array_contains("target_doc_ids", F.col("doc_id")), F.lit(False))
    rows = rows.withColumn("match_", F.col("own_") | of_doc | listed)
    rows = rows.withColumns({"uploads_": F.max("upload_").over(all_hits), "matches_": F.max("match_").over(all_hits), "compared_": F.coalesce(F.col("question").rlike(posture.COMPARING), F.lit(False))})
    status = (
        F.when(F.col("uploads_"), F.when(F.col("compared_"), "applied:user_upload_with_comparison_authorities").otherwise("applied:user_upload_only"))
        .when(F.col("target_case").isNull(), "not_applied:no_target_case").when(~F.col("matches_"), "not_applied:no_case_match").otherwise("applied")
    )
    rows = rows.withColumn("prompt_status", status)
    rows = rows.withColumn("group_", (F.col("uploads_") & ~F.col("upload_")).cast("int"))
    open_ = F.when(F.col("uploads_"), F.col("upload_") | F.col("compared_")).when(F.col("prompt_status") == "applied", F.col("match_")).otherwise(True)
    place = F.row_number().over(W.partitionBy(query).orderBy("group_", "rank", "chunk_id"))
    inside = F.row_number().over(W.partitionBy(query, "group_").orderBy("rank", "chunk_id"))
    most = F.when(F.col("group_") == 1, COMPARED_CHUNKS).when(F.col("prompt_status") == "applied", TARGET_CHUNKS)
    kept = rows.where(open_).withColumns({"inside_": inside, "place": place.cast("long")}).where(most.isNull() | (F.col("inside_") <= most))
    return kept.select(*hits.columns, "prompt_status", "place")


def sentence_limit(depth: Column, upload: Column) -> Column:
    limit = F.when(F.lower(F.trim(F.coalesce(depth, F.lit("")))) == "detailed", DETAILED_SENTENCES).otherwise(SENTENCES)
    return F.when(upload, F.greatest(limit, F.lit(UPLOAD_SENTENCES))).otherwise(limit)


def choice(chosen: DataFrame, questions: DataFrame, sentences: DataFrame, *, query: str = "query_id") -> DataFrame:
    """One row for each question: the kind of context, its number of blocks and of sentences, and its sources.

    ``chosen``: rows of ``prompt_chunks``. ``questions``: query, target_case, depth,
    leads. ``sentences``: query, rank, chunk_id of sentences of those chunks, best first.
    """
    counts = chosen.groupBy(query).agg(F.count("*").alias("n"), F.max(F.col("doc_type") == "user_upload").alias("upload"), F.array_sort(F.collect_list(F.struct("place", "chunk_id"))).alias("own"))
    rows = questions.select(query, "target_case", "depth", F.coalesce("leads", F.lit(False)).alias("leads")).join(counts, query, "left")
    rows = rows.withColumns({"upload": F.coalesce("upload", F.lit(False)), "own": F.transform("own", lambda x: x["chunk_id"])})
    rows = rows.withColumn("sentence_limit", sentence_limit(F.col("depth"), F.col("upload")))
    said = sentences.join(rows.select(query, "sentence_limit"), query).join(chosen.select(query, "chunk_id"), [query, "chunk_id"], "left_semi").where(F.col("rank") <= F.col("sentence_limit"))
    said = said.groupBy(query).agg(F.count("*").alias("n_said"), F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("said"))  # bounded by the limit
    rows = rows.join(said.select(query, "n_said", F.transform("said", lambda x: x["chunk_id"]).alias("said")), query, "left")
    status = (
        F.when(F.col("n").isNull(), "not_applied:no_prompt_chunks").when(F.col("upload"), "applied:user_upload_context").when(F.col("leads"), "applied:research_leads")
        .when(F.col("target_case").isNull(), "not_applied:no_target_case").when(F.col("n_said").isNull(), "not_applied:no_sentence_evidence").otherwise("applied:sentence_evidence")
    )
    rows = rows.withColumn("context_status", status)
    by_sentence = F.col("context_status") == "applied:sentence_evidence"
    blocks = F.when(F.col("n").isNull(), 0).when(by_sentence, F.col("n_said")).when(F.col("context_status") == "applied:research_leads", F.col("n") + 1).otherwise(F.col("n"))
    sources = F.coalesce(F.when(by_sentence, F.col("said")).otherwise(F.col("own")), F.array().cast("array<string>"))
    return rows.select(query, "context_status", blocks.cast("long").alias("n_blocks"), F.col("sentence_limit").cast("long").alias("sentence_limit"), sources.alias("source_chunk_ids"))


def blocks(chosen: DataFrame, picked: DataFrame, questions: DataFrame, sentences: DataFrame, *, query: str = "query_id") -> DataFrame:
    """(query, position, block): the finished blocks of each question's context.

    ``picked``: rows of ``choice``. ``sentences``: also with sentence and score.
    """
    kinds = picked.select(query, "context_status", "sentence_limit")
    rows = chosen.join(kinds, query)
    by_sentence = F.col("context_status") == "applied:sentence_evidence"
    upload = F.col("context_status") == "applied:user_upload_context"
    columns = chosen.columns
    whole = rows.where(~by_sentence).select(query, F.col("place").alias("position"), F.when(upload, drafting.upload_block(columns)).otherwise(drafting.chunk_block(columns)).alias("block"))
    leads = kinds.where("context_status = 'applied:research_leads'").join(questions.select(query, "question"), query).select(query, F.lit(0).cast("long").alias("position"), drafting.leads_block("question").alias("block"))
    meta = [c for c in ("doc_id", "doc_type", "case_name", "citation", "court_level") if c in columns]
    said = sentences.join(kinds.where(by_sentence), query).where(F.col("rank") <= F.col("sentence_limit")).join(chosen.select(query, "chunk_id", *meta), [query, "chunk_id"])
    said = said.select(query, F.col("rank").cast("long").alias("position"), drafting.sentence_block(["chunk_id", *meta], "sentence", "score").alias("block"))
    return whole.unionByName(leads).unionByName(said)
