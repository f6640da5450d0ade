"""The main plan: claims to chunks to pair scores to verdicts, for any number of claims."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..operators import answers, chunking, claims, retrieval, verification
from ..sources import segments
from ..storage import written
from .progress import Progress


def verify_claims(docs: DataFrame, asked: DataFrame, *, k: int = config.MERGED_LIMIT, scorer: Callable | None = None, index: str | None = None, progress: Progress | None = None) -> DataFrame:
    """Verdict of every claim (claim_id, text) against (doc_id, text, court_level, doc_type).

    With ``index`` (a folder of ``sources.segments`` over the word windows of these documents)
    nothing but the asked postings is read to find evidence. Evidence is bounded by ``k`` chunks a claim, so what meets the pair scorer
    grows with the claims and not with the documents.
    """
    watched = progress.watched if progress else lambda stage, df: df
    said = watched("claims", asked).select("claim_id", "text")
    if index:
        hits = segments.search(said, index, k=k, query="claim_id")
    else:
        chunks = written(chunking.word_windows(docs.select("doc_id", "text")), "chunks")
        hits = retrieval.bm25_topk(chunks, said, k=k, query="claim_id")
    hits = written(watched("retrieval", hits), "hits")
    if index:
        chunks = segments.chunks_of_hits(hits, index)
    meta = docs.select("doc_id", "court_level", "doc_type")
    premise = chunks.select("chunk_id", "doc_id", F.col("text").alias("premise"))
    pairs = hits.join(premise, "chunk_id").join(meta, "doc_id").join(asked.select("claim_id", F.col("text").alias("hypothesis")), "claim_id")
    pairs = verification.heuristic_scores(pairs, "premise", "hypothesis", scorer).select(
        "claim_id", "chunk_id", (F.col("rank") - 1).alias("idx"), F.col("entailment").alias("e"), F.col("contradiction").alias("c"),
        verification.authority("doc_type", "court_level").alias("w"), F.lit(config.TIERS["retrieved"]).alias("tier"),
        verification.overlap_valid("premise", "hypothesis").alias("overlap_valid"), verification.posture_valid("premise", "hypothesis").alias("posture_valid"),
    )
    scored = verification.aggregate(watched("pair_scores", pairs))
    best = hits.select("claim_id", (F.col("rank") - 1).alias("best_idx"), F.col("chunk_id").alias("best_chunk_id"))
    out = asked.select("claim_id", "text").join(scored.join(best, ["claim_id", "best_idx"], "left"), "claim_id", "left")
    judged = out.withColumn("verdict", verification.verdict("final_score", "is_contradicted", F.col("final_score").isNotNull())).select(
        "claim_id", "text", "verdict", F.coalesce("final_score", F.lit(0.0)).alias("final_score"), F.coalesce("support_ratio", F.lit(0.0)).alias("support_ratio"), "best_chunk_id"
    )
    return watched("verdicts", judged)


def review_answers(docs: DataFrame, texts: DataFrame, *, scorer: Callable | None = None, index: str | None = None) -> DataFrame:
    """Answers (answer_id, text) decomposed, verified and summed up: one row each."""
    found = claims.decomposed(texts.select(F.col("answer_id").alias("doc_id"), "text")).withColumn("reason", claims.skip_reason(F.col("text"))).where("reason is null")
    judged = verify_claims(docs, found.select(F.concat_ws("/", "doc_id", "claim_id").alias("claim_id"), "text"), scorer=scorer, index=index)
    judged = judged.withColumn("answer_id", F.substring_index("claim_id", "/", 1))
    return texts.select(F.col("answer_id").cast("string").alias("answer_id")).join(answers.support_summary(judged, by="answer_id"), "answer_id", "left")
