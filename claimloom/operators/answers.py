"""From judged claims to answers: links, annotations, blocks, summaries, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config, lexicon
from ..functions import text as tx
from .verification import support_level


def links(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Up to two links of each claim: to its best supporting and contradicting chunk.

    ``claims``: claim_id, supporting (chunk id), supporting_score, contradicting,
    contradicting_score, is_contradicted. ``citations``: chunk_id, source_label.
    """
    both = F.array(
        F.struct(F.lit("supporting").alias("relationship"), F.col("supporting").alias("chunk_id"), F.col("supporting_score").alias("score")),
        F.struct(F.lit("contradicting").alias("relationship"), F.when(F.col("is_contradicted"), F.col("contradicting")).alias("chunk_id"), F.col("contradicting_score").alias("score")),
    )
    rows = claims.select("claim_id", F.explode(both).alias("l")).select("claim_id", "l.*").where("chunk_id is not null")
    return rows.join(citations.select("chunk_id", "source_label"), "chunk_id", "left")


def annotations(claims: DataFrame, linked: DataFrame) -> DataFrame:
    """(claim_id, support_level, explanation, evidence): supporting links first, then by score and label."""
    key = F.struct((F.col("relationship") != "supporting").cast("int").alias("o"), (-F.coalesce("score", F.lit(0.0))).alias("s"), F.coalesce("source_label", F.lit("")).alias("label"), "relationship", "chunk_id", "score")
    grouped = linked.groupBy("claim_id").agg(F.array_sort(F.collect_list(key)).alias("evidence"))
    return claims.join(grouped, "claim_id", "left").select("claim_id", support_level(F.col("verdict")).alias("support_level"), "verdict", F.coalesce(F.size("evidence"), F.lit(0)).alias("n_evidence"), "evidence")


def support_summary(claims: DataFrame, *, by: str) -> DataFrame:
    """Counts of claims by support, without rhetorical ones, and the unsupported share."""
    level = support_level(F.col("verdict"))
    real = ~F.col("text").rlike(lexicon.RHETORICAL)
    out = claims.groupBy(by).agg(
        F.count_if(real).alias("total"),
        F.count_if(real & (level == "supported")).alias("supported"),
        F.count_if(real & (level == "possibly_supported")).alias("possibly_supported"),
        F.count_if(real & (level == "unsupported")).alias("unsupported"),
        F.count_if(~real).alias("rhetorical"),
    )
    ratio = F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("unsupported") / F.col("total"), 3))
    out = out.withColumn("unsupported_ratio", ratio)
    return out.withColumn("show_warning", (F.col("total") > 0) & (F.col("unsupported_ratio") >= config.UNSUPPORTED_RATIO))


def warning(rows: DataFrame) -> DataFrame:
    """``rows`` of ``support_summary`` with the kind and the message of their warning, or nulls."""
    # The wording of the warning.
    share = F.format_string(" (%d of %d claims unsupported).", F.col("unsupported"), F.col("total"))
    start = F.when(F.col("unsupported") == F.col("total"), "This response is largely unsupported by retrieved evidence").otherwise("A large share of this response is unsupported by retrieved evidence")
    return rows.withColumns({"warning_kind": F.when(F.col("show_warning"), "unsupported_majority"), "warning": F.when(F.col("show_warning"), F.concat(start, share))})


def span_groups(spans: DataFrame, *, by: str) -> DataFrame:
    """Overlapping spans [start, end) as one group; spans that only touch stay apart."""
    w = W.partitionBy(by).orderBy("start", "end", "claim_id")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = (before.isNull() | (F.col("start") >= before)).cast("int")
    return spans.where("start < end").withColumn("fresh", fresh).withColumn("group_no", F.sum("fresh").over(w)).drop("fresh")


def blocks(answers: DataFrame, spans: DataFrame, *, by: str) -> DataFrame:
    """Answers cut into claim blocks and the classified text between them.

    ``answers``: by, text. ``spans``: by, claim_id, start, end, verdict (start from 0).
    """
    level = support_level(F.col("verdict"))
    worst = F.max(F.when(F.col("verdict") == "CONTRADICTED", 3).when(level == "unsupported", 2).when(level == "possibly_supported", 1).otherwise(0))
    merged = span_groups(spans, by=by).groupBy(by, "group_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("claim_count"), worst.alias("worst"))
    names = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("worst") + 1)
    claim_blocks = merged.select(
        by, "start", "end", "claim_count",
        names(["verified_claim", "possibly_supported_claim", "unsupported_claim", "contradicted_claim"]).alias("type"),
        names(["supported", "possibly_supported", "unsupported", "unsupported"]).alias("support_level"),
    )
    w = W.partitionBy(by).orderBy("start")
    edges = answers.select(by, F.length("text").cast("long").alias("start")).withColumn("end", F.col("start")).unionByName(merged.select(by, "start", "end"))
    gaps = edges.withColumn("from", F.coalesce(F.lag("end").over(w), F.lit(0))).where(F.col("start") > F.col("from")).select(by, "from", F.col("start").alias("to"))
    raw = answers.join(gaps, by).withColumn("raw", F.expr("substr(text, cast(from + 1 as int), cast(to - from as int))"))
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    body = tx.strip("raw")
    kind = nonclaim_type(body)
    text_blocks = raw.where(body != "").select(
        by, (F.col("from") + lead).alias("start"), (F.col("from") + lead + F.length(body)).alias("end"), F.lit(0).cast("long").alias("claim_count"),
        kind.alias("type"), F.when(kind == "unverified_claim_candidate", "unsupported").alias("support_level"),
    )
    both = claim_blocks.unionByName(text_blocks)
    return both.withColumn("block_no", F.row_number().over(w).cast("long") - 1)


def nonclaim_type(x: Column) -> Column:
    t = tx.collapse(x)
    factual = (F.length(t) >= 12) & ~t.rlike(r"\?$") & t.rlike(lexicon.FACT_ANCHOR) & t.rlike(lexicon.ANSWER_VERB)
    return (
        F.when(t.rlike(lexicon.CAVEAT), "caveat").when(t.rlike(lexicon.LABEL), "transition").when(factual, "unverified_claim_candidate")
        .when(t.rlike(lexicon.TRANSITION), "transition").otherwise("derived_explanation")
    )


def block_summary(rows: DataFrame, *, by: str) -> DataFrame:
    claim = F.col("claim_count") > 0
    return rows.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(claim).alias("claim_blocks"), F.count_if(~claim).alias("non_claim_blocks"),
        F.count_if(claim | (F.col("type") == "unverified_claim_candidate")).alias("verification_required_blocks"),
        F.count_if(F.col("type") == "unverified_claim_candidate").alias("unverified_claim_candidates"),
        *[F.count_if(F.col("support_level") == s).alias(f"{s}_blocks") for s in ("supported", "possibly_supported", "unsupported")],
    )


def repaired(answers: DataFrame, claims: DataFrame, *, by: str, limit: int = config.REPAIR_CLAIMS) -> DataFrame:
    """Answers with too many unsupported claims, rewritten from their supported ones.

    ``claims``: by, text, verdict, start. At most ``limit`` distinct supported
    claims stay, in the order of the answer.
    """
    summary = support_summary(claims, by=by).select(by, "unsupported_ratio", "total")
    good = claims.where(F.col("verdict").isin("VERIFIED", "SUPPORTED") & (F.length("text") >= 18)).withColumn("sentence", tx.terminated(tx.collapse("text")))
    first = good.groupBy(by, F.lower("sentence").alias("k")).agg(F.min(F.struct("start", "sentence")).alias("m")).select(by, "m.*")
    picked = first.withColumn("n", F.row_number().over(W.partitionBy(by).orderBy("start", "sentence"))).where(F.col("n") <= limit)
    text = picked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("n", "sentence"))).alias("s")).select(by, F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("repair"))
    joined = answers.join(summary, by, "left").join(text, by, "left")
    status = (
        F.when(F.coalesce("total", F.lit(0)) == 0, "not_applied:no_claims").when(F.col("unsupported_ratio") < config.UNSUPPORTED_RATIO, "not_applied:unsupported_ratio_below_threshold")
        .when(F.col("repair").isNull(), "not_applied:no_supported_or_evidence_fallback").when(F.col("repair") == F.col("text"), "not_applied:repair_matches_response").otherwise("applied:unsupported_claim_repair")
    )
    joined = joined.withColumn("status", status)
    return joined.select(by, "status", F.when(F.startswith("status", F.lit("applied")), F.col("repair")).otherwise(F.col("text")).alias("answer"))


def highlights(candidates: DataFrame, *, by: str) -> DataFrame:
    """Non-overlapping spans, greedily from the left; a better one replaces the last.

    ``candidates``: by, start, end, priority (smaller is better). The choice
    depends on the ones before, so it is a fold over each answer's spans.
    """
    spans = F.array_sort(F.collect_list(F.struct("start", "end", "priority")))
    empty = F.expr("cast(array() as array<struct<start: bigint, end: bigint, priority: bigint>>)")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        return (
            F.when(F.size(acc) == 0, F.array(x)).when(x["start"] >= last["end"], F.concat(acc, F.array(x)))
            .when(x["priority"] < last["priority"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(acc)
        )

    return candidates.groupBy(by).agg(spans.alias("s")).select(by, F.inline(F.aggregate("s", empty, step)))


def cases_by_level(evidence: DataFrame, *, by: list[str]) -> DataFrame:
    """Distinct references of each support level: best score and all claims, best first."""
    key = [F.lower(F.trim(F.coalesce(c, F.lit("")))).alias(c) for c in ("doc_id", "chunk_id", "source_label")]
    rows = evidence.select(*by, *key, "score", "claim_id")
    return rows.groupBy(*by, "doc_id", "chunk_id", "source_label").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("claim_id")).alias("claim_ids"))


def cases_of_claims(links: DataFrame, best: DataFrame, *, claim: str = "claim_id") -> DataFrame:
    """(claim, relation, doc_id, chunk_id, label, score): the best supporting and the best contradicting case of each claim.

    ``links``: claim, relationship (``supporting`` or ``contradicting``), doc_id,
    chunk_id, source_label, score. ``best``: the same columns from the
    verification itself, which stand in where a claim has no link of a kind.
    """
    columns = ["doc_id", "chunk_id", "source_label", "score"]
    both = links.select(claim, "relationship", *columns, F.lit(0).alias("from_")).unionByName(best.select(claim, "relationship", *columns, F.lit(1).alias("from_")))
    order = F.struct(-F.col("from_"), F.coalesce("score", F.lit(float("-inf"))), F.coalesce("source_label", F.lit("")), F.coalesce("chunk_id", F.lit("")))
    picked = both.where(F.col("relationship").isin("supporting", "contradicting")).groupBy(claim, "relationship").agg(F.max_by(F.struct(*columns), order).alias("c"))
    return picked.select(claim, F.when(F.col("relationship") == "supporting", "support").otherwise("contradiction").alias("relation"), "c.doc_id", "c.chunk_id", F.col("c.source_label").alias("label"), "c.score")


def cases_of_interactions(cases: DataFrame, claims: DataFrame, *, by: str, claim: str = "claim_id") -> DataFrame:
    """(by, relation, doc_id, chunk_id, label, score): the distinct cases of each interaction with their best score."""
    key = [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("doc_id", "chunk_id", "label")]
    rows = cases.join(claims.select(by, claim), claim).withColumn("k_", F.concat_ws("\u0001", *key))
    best = rows.groupBy(by, "relation", "k_").agg(F.max_by(F.struct("doc_id", "chunk_id", "label", "score"), F.coalesce("score", F.lit(float("-inf")))).alias("c"))
    return best.select(by, "relation", "c.*")
