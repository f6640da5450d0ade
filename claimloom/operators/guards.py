"""Guards on positive verdicts: each gives a status; blocked ones lose their support.

All work on token sets of one row: the claim, the text of its evidence with its
name and citation, and what is known of the question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text as tx

# Questions that bind the answer to its sources, and claims that only lean on related ones.
BOUND_QUESTION = r"(?i)\b(?:use\s+only\s+retrieved\s+sources|retrieved\s+sources\s+do\s+not\s+mention|if\s+the\s+retrieved\s+sources\s+do\s+not|source\s+discipline|do\s+not\s+(?:infer|guess)|say\s+that\s+instead)\b"
RELATED_CLAIM = r"(?i)^\s*Based\s+on\s+related\s+retrieved\s+authorit(?:y|ies)\b"
POSITIVE = ["VERIFIED", "SUPPORTED", "POSSIBLE_SUPPORT"]


def _tokens(x: Column) -> Column:
    return tx.token_set(F.coalesce(x, F.lit("")), lexicon.EVIDENCE_STOPWORDS, 2)


def target_alignment(claim: Column, evidence: Column, target: Column) -> Column:
    """Claims on a target case share two tokens with its evidence, short ones one."""
    c, e = _tokens(claim), _tokens(evidence)
    shared = F.size(F.array_intersect(c, e))
    return (
        F.when(F.coalesce(tx.strip(target), F.lit("")) == "", "not_applied:no_target_case").when((F.size(c) == 0) | (F.size(e) == 0), "not_applied:no_alignment_tokens")
        .when(shared >= 2, "passed:token_overlap").when((F.size(c) <= 5) & (shared > 0), "passed:short_claim_overlap").otherwise("blocked:low_target_evidence_overlap")
    )


def query_subject(claim: Column, evidence: Column, label: Column, question: Column, uploads: Column) -> Column:
    """Where a question binds the answer to its sources, the evidence names its subject."""
    generic = F.array(*[F.lit(w) for w in lexicon.SUBJECT_GENERIC])
    subject = F.filter(_tokens(question), lambda t: (F.length(t) >= 4) & ~F.array_contains(generic, t))
    there = _tokens(F.concat_ws(" ", claim, evidence))
    return (
        F.when(~label.isin(POSITIVE), "not_applied:verdict_not_supported").when(F.coalesce(tx.strip(question), F.lit("")) == "", "not_applied:no_query")
        .when(~question.rlike(BOUND_QUESTION), "not_applied:not_source_discipline_query").when(uploads, "not_applied:user_upload_context")
        .when(F.size(subject) < 2, "not_applied:not_enough_subject_tokens").when(F.size(F.array_except(subject, there)) == 0, "passed:query_subject_alignment").otherwise("blocked:query_subject_mismatch")
    )


def is_high_risk(*, target: Column, uploads: Column, status: Column, source: Column, context: Column, mode: Column, missing_case: Column) -> Column:
    """Answers without a resolved source."""
    text = lambda c: F.coalesce(c, F.lit(""))
    open_ = ~F.startswith(text(status), F.lit("resolved:")) | text(source).isin("unresolved", "retrieval_convergence") | (tx.strip(text(missing_case)) != "")
    loose = F.contains(text(context), F.lit("fallback")) | F.contains(text(context), F.lit("research_leads")) | F.contains(text(mode), F.lit("research_leads"))
    return (text(target) == "") & ~F.startswith(text(context), F.lit("applied:user_upload")) & ~uploads & (open_ | loose)


def high_risk(claim: Column, evidence: Column, label: Column, *, risky: Column, leads: Column, unresolved_citation: Column) -> Column:
    """Without a resolved source a claim needs two shared tokens, longer ones three."""
    c, e = _tokens(claim), _tokens(evidence)
    shared = F.size(F.array_intersect(c, e))
    needed = F.when(F.size(c) <= 6, 2).otherwise(3)
    other = unresolved_citation.isNotNull() & ~F.contains(tx.compact(F.coalesce(evidence, F.lit(""))), tx.compact(unresolved_citation))
    return (
        F.when(~label.isin(POSITIVE), "not_applied:verdict_not_supported").when(~risky, "not_applied:not_high_risk").when(claim.rlike(RELATED_CLAIM), "blocked:high_risk_related_authority_claim")
        .when(other, "blocked:high_risk_unresolved_citation_mismatch").when(leads, "passed:research_leads_not_strictly_gated")
        .when((F.size(c) == 0) | (F.size(e) == 0), "not_applied:no_alignment_tokens").when(shared >= needed, "passed:high_risk_content_overlap").otherwise("blocked:high_risk_low_source_alignment")
    )


def apply_all(rows: DataFrame, statuses: list[str], *, label: str) -> DataFrame:
    """``rows`` with final_label: the first guard that blocks or demotes decides."""
    first = F.coalesce(*[F.when(F.col(s).rlike("^(?:blocked|demote)"), F.col(s)) for s in statuses])
    return rows.withColumn("guard", first).withColumn("final_label", F.when(F.startswith("guard", F.lit("blocked")), "UNSUPPORTED").when(F.startswith("guard", F.lit("demote")), "POSSIBLE_SUPPORT").otherwise(F.col(label)))


def answer_mode(*, generation: Column, fallback: Column, refused: Column, retrieval: Column, leads: Column) -> Column:
    return (
        F.when(fallback, "missing_case_topic_fallback").when(refused, "refusal").when(leads, "research_leads").when((generation == "direct") & ~retrieval, "direct").otherwise("retrieval_grounded")
    )


def topic_question(question: Column, missing: Column) -> Column:
    """A question without its missing case and the words that ask for a holding."""
    at = F.position(F.lower(missing), F.lower(question))
    cut = F.when(F.coalesce(missing, F.lit("")) != "", F.when(at > 0, F.concat(F.substring(question, F.lit(1), at - 1), F.lit(" "), F.substring(question, at + F.length(missing), F.length(question)))).otherwise(question)).otherwise(question)
    for pattern in (r"(?i)^\s*In\s*,?\s*", r"(?i)\bwhat\s+did\s+(?:the\s+)?(?:supreme\s+)?court\s+(?:hold|decide|do)\b", r"(?i)\b(?:that|this|the)\s+case\b", r"(?i)\b(?:hold|holding|held)\b"):
        cut = F.regexp_replace(cut, pattern, " ")
    return F.regexp_replace(tx.collapse(cut), "^[ ,.;:]+|[ ,.;:]+$", "")


def located(rows: DataFrame, *, answer: str, claim: str, start: str) -> DataFrame:
    """``rows`` with start_at and end_at of the claim in the answer, from 0.

    The given start if the text stands there; else the occurrence nearest to
    it, first as it is, then stripped, then without regard to case; else null.
    """

    def nearest(hay: Column, needle: Column) -> Column:
        # the first one from the start on, and the last one up to it by the reversed text
        size, at = F.length(needle), F.greatest(F.coalesce(F.col(start), F.lit(0)).cast("int"), F.lit(0))
        last = F.length(hay) - size
        after = F.position(needle, hay, at + 1) - 1
        before = last - (F.position(F.reverse(needle), F.reverse(hay), F.greatest(last - at, F.lit(0)) + 1) - 1)
        right, left = F.when(after >= 0, after), F.when(before <= last, before)
        best = F.when(right.isNull() | (at - left <= right - at), left).otherwise(right)
        return F.when((size > 0) & best.isNotNull(), F.struct(best.cast("long").alias("s"), (best + size).cast("long").alias("e")))

    a, c = F.col(answer), F.col(claim)
    own = F.when(F.substring(a, F.col(start) + 1, F.length(c)) == c, F.struct(F.col(start).cast("long").alias("s"), (F.col(start) + F.length(c)).cast("long").alias("e")))
    found = F.coalesce(own, nearest(a, c), nearest(a, tx.strip(c)), nearest(F.lower(a), F.lower(c)))
    return rows.withColumn("at_", found).select("*", F.col("at_.s").alias("start_at"), F.col("at_.e").alias("end_at")).drop("at_")
