"""Evidence for answers: sentence scores, tiers of chunks, topic fallback, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config, lexicon
from ..functions import text as tx


def sentences(text: str) -> Column:
    """Split after an end mark before a capital, digit, quote or bracket, without print noise."""
    return F.filter(F.split(tx.clean_legal(text), r'(?<=[.!?])\s+(?=[A-Z0-9"(])'), lambda s: s != "")


def sentence_score(sentence: Column, tokens: Column, *, index: Column, named: Column) -> Column:
    """Points of a sentence for a question's tokens; 0 where it is refused."""
    low = F.lower(sentence)
    lead = sentence.rlike(lexicon.HOLDING_LEAD) | sentence.rlike(lexicon.HOLDING_CONCLUSION)
    shared = F.size(F.array_intersect(tx.token_set(sentence, lexicon.EVIDENCE_STOPWORDS, 2), tokens))
    refused = (
        (F.length(sentence) < 24) | sentence.rlike(lexicon.INCOMPLETE) | sentence.rlike(lexicon.CAPTION) | sentence.rlike(lexicon.FRAGMENT_START)
        | F.regexp_replace(sentence, r"""[.,;:!?"']+$""", "").rlike(lexicon.TRUNCATED_END) | (F.contains(low, F.lit("question presented")) & ~lead) | ((shared == 0) & ~lead)
    )
    when = lambda c, points: F.when(c, float(points)).otherwise(0.0)
    points = (
        shared * 4.0 + F.when(F.size(tokens) > 0, shared / F.size(tokens)).otherwise(0.0) + when(lead, 10) + when(low.rlike(r"^(?:that court|the district court)\b"), -12)
        + when(sentence.rlike(lexicon.LOWER_COURT), -6) + when(F.startswith(low, F.lit("held:")), 4) + when(named, 2) + when((index == 0) & lead, 1)
        + when(F.length(sentence) > 320, -1) + when(F.contains(low, F.lit("justice")) & F.contains(low, F.lit("dissent")), -2)
    )
    return F.when(refused, 0.0).otherwise(F.round(points, 6))


def best_sentences(hits: DataFrame, *, query: str, limit: int = 3) -> DataFrame:
    """The best distinct sentences of each query's chunks.

    ``hits``: query, tokens (of the question), chunk_id, chunk_index, text, named.
    """
    rows = hits.select(query, "tokens", "chunk_id", "chunk_index", "named", F.posexplode(sentences("text")).alias("sent", "sentence"))
    scored = rows.withColumn("score", sentence_score(F.col("sentence"), F.col("tokens"), index=F.col("sent"), named=F.col("named"))).where("score > 0")
    order = [F.desc("score"), F.asc("chunk_index"), F.asc("sent"), F.asc("chunk_id")]
    first = scored.withColumn("d", F.row_number().over(W.partitionBy(query, F.lower("sentence")).orderBy(*order))).where("d = 1")
    rank = F.row_number().over(W.partitionBy(query).orderBy(*order)).cast("long")
    return first.withColumn("rank", rank).where(F.col("rank") <= limit).select(query, "rank", "chunk_id", "sentence", "score")


def scope(tiers: DataFrame, *, query: str, key: str) -> DataFrame:
    """Chunks to verify against, from rows (query, key, tier).

    Sentence evidence and its sources end the search where there are any; else
    the prompt, the target document and the target case; else what was
    retrieved. A chunk of several tiers takes the best.
    """
    ranks = F.create_map(*[F.lit(x) for kv in config.TIERS.items() for x in kv])
    ranked = tiers.withColumn("r", ranks[F.col("tier")]).groupBy(query, key).agg(F.min("r").alias("tier_rank"))
    least = F.min("tier_rank").over(W.partitionBy(query))
    top = F.when(least <= 1, 1).when(least <= 4, 4).otherwise(5)
    return ranked.withColumn("top", top).where("tier_rank <= top").drop("top")


def topic_fallback(hits: DataFrame, *, query: str, limit: int = config.TOPIC_FALLBACK_LIMIT) -> DataFrame:
    """Chunks for a question whose case is missing, by shared topic tokens.

    ``hits``: query, tokens, chunk_id, rank, text (cut at 2,400 characters).
    """
    head = F.substring("text", 1, 2400)
    shared = F.size(F.array_intersect(tx.token_set(head, lexicon.EVIDENCE_STOPWORDS, 2), "tokens"))
    points = 4.0 * shared + shared / F.greatest(F.size("tokens"), F.lit(1)) + F.when(head.rlike(lexicon.TOPIC), 2.0).otherwise(0.0)
    scored = hits.withColumns({"shared": shared, "score": F.round(points, 6)}).where("shared > 0")
    place = F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), "rank", "chunk_id")).cast("long")
    return scored.withColumn("place", place).where(F.col("place") <= limit).select(query, "place", "chunk_id", "score")


def prompt_context(chunks: DataFrame, *, query: str, order: str) -> DataFrame:
    """(query, context): the numbered, non-empty texts of each query."""
    rows = chunks.where(tx.collapse("text") != "").groupBy(query).agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("t"))
    return rows.select(query, F.array_join(F.transform("t", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"])), "\n\n").alias("context"))
