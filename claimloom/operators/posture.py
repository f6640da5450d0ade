"""Disposition and opinion of a case from its text, and what they do to an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text as tx

# Patterns of dispositions and of opinion headers, first match first.
CERT_DENIED = r"(?i)petition for (?:a writ of )?certiorari is denied"
CERT_DENIED_SAID = r"(?i)\b(?:denied certiorari|certiorari (?:is|was) denied|petition for (?:a writ of )?certiorari (?:is|was) denied)\b"
DISPOSITIONS = [
    (CERT_DENIED, "cert_denial", "denied certiorari"),
    (r"(?is)(?:petition|writ) for (?:a writ of )?certiorari is granted.*?vacated.*?remanded", "gvr", "granted certiorari, vacated, and remanded"),
    (r"(?is)\b(?:judgment|decision).{0,40}\bvacated\b.{0,40}\bremanded\b", "merits", "vacated and remanded"),
    (r"(?is)\b(?:judgment|decision).{0,40}\breversed\b", "merits", "reversed"),
    (r"(?is)\b(?:judgment|decision).{0,40}\baffirmed\b", "merits", "affirmed"),
    (r"(?is)\b(?:judgment|decision).{0,40}\bvacated\b", "merits", "vacated"),
    (r"(?is)\b(?:judgment|decision).{0,40}\bremanded\b", "merits", "remanded"),
]
HEADERS = [
    ("dissent_from_denial", [r"(?i)JUSTICE\s+([A-Z][A-Z'.-]+),?\s+dissenting from the denial of certiorari", r"(?i)([A-Z][A-Z'.-]+),\s+J\.,\s+dissenting from the denial of certiorari"]),
    ("concurrence", [r"(?i)JUSTICE\s+([A-Z][A-Z'.-]+),?\s+concurring(?:\s+in\s+the\s+judgment)?", r"(?i)([A-Z][A-Z'.-]+),\s+J\.,\s+concurring(?:\s+in\s+the\s+judgment)?"]),
    ("dissent", [r"(?i)JUSTICE\s+([A-Z][A-Z'.-]+),?\s+dissenting\b", r"(?i)([A-Z][A-Z'.-]+),\s+J\.,\s+dissenting\b"]),
]
UPLOAD_GENERIC = "according agreement client document draft file memo memorandum motion my northstar cedar riley section states uploaded using".split()
UPLOAD = r"(?i)\b(?:upload(?:ed)?|my (?:document|draft|file|memo|motion|agreement))\b"
COMPARING = r"(?i)\b(?:compare|comparison|analog(?:y|ize)|distinguish|similarit(?:y|ies)|differences?|relevant\s+(?:corpus\s+)?cases?|prior\s+cases?|precedent|authorit(?:y|ies)|case\s+law|external\s+(?:cases|authority))\b"
NO_SUPPORT = "Insufficient support in retrieved authorities to answer the question."


def _first(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def of_text(text: Column) -> dict[str, Column]:
    """decision_type, court_action, opinion_role, author and is_separate of a text."""
    kind = action = None
    for pattern, k, a in DISPOSITIONS:
        hit = text.rlike(pattern)
        kind = F.when(hit, k) if kind is None else kind.when(hit, k)
        action = F.when(hit, a) if action is None else action.when(hit, a)
    role, authors = None, []
    for name, patterns in HEADERS:
        found = _first(text, patterns)
        authors.append(found)
        role = F.when(found.isNotNull(), name) if role is None else role.when(found.isNotNull(), name)
    role = role.when(text.rlike(r"(?i)\bPER CURIAM\b"), "per_curiam").when(action.isNotNull(), "majority")
    author = F.initcap(F.lower(F.coalesce(*authors)))
    return {"decision_type": kind, "court_action": action, "opinion_role": role, "author": author, "is_separate": author.isNotNull()}


def of_cases(chunks: DataFrame, *, case: str, order: str) -> DataFrame:
    """Posture of each case from the first 1,600 characters of its first three chunks."""
    heads = chunks.groupBy(case).agg(F.slice(F.array_sort(F.collect_list(F.struct(order, F.substring("text", 1, 1600).alias("t")))), 1, 3).alias("c"))
    text = heads.select(case, F.array_join(F.transform("c", lambda x: x["t"]), "\n").alias("text"))
    return text.select(case, *[v.alias(k) for k, v in of_text(F.col("text")).items()]).where("decision_type is not null or opinion_role is not null")


def denial_answer(rows: DataFrame, *, answer: str, case: str, intent: str) -> DataFrame:
    """Answers on a denied petition with a named separate opinion, put in fixed words."""
    separate = F.col("opinion_role").isin("dissent_from_denial", "dissent", "concurrence")
    denied = F.coalesce((F.col("decision_type") == "cert_denial") & (F.col("court_action") == "denied certiorari"), F.lit(False))
    status = (
        F.when(F.col("decision_type").isNull() & F.col("opinion_role").isNull(), "not_applied:no_case_posture").when(~denied, "not_applied:not_cert_denial")
        .when(F.col(intent).isNotNull() & ~F.col(intent).isin("posture", "author"), "not_applied:intent_not_posture_or_author")
        .when(~F.coalesce(separate, F.lit(False)), "not_applied:no_named_separate_opinion").when(F.col("author").isNull(), "not_applied:no_author").otherwise("applied:cert_denial_posture")
    )
    who = F.concat(F.lit("Justice "), F.col("author"))
    said = F.when(F.col("opinion_role") == "dissent_from_denial", F.concat(who, F.lit(" dissented from the denial of certiorari."))).when(F.col("opinion_role") == "dissent", F.concat(who, F.lit(" dissented."))).otherwise(F.concat(who, F.lit(" concurred in the disposition.")))
    first = F.concat(F.lit("The Supreme Court denied certiorari"), F.coalesce(F.concat(F.lit(" in "), F.col(case)), F.lit("")), F.lit("."))
    out = rows.withColumn("status", status)
    return out.withColumn("answer_after", F.when(F.startswith("status", F.lit("applied")), F.concat(first, F.lit("\n\n"), said)).otherwise(F.col(answer)))


def denial_guard(rows: DataFrame, *, answer: str, evidence: str, replacement: str) -> DataFrame:
    """Answers that speak of a denial which neither the posture nor the evidence states lose it."""
    a = F.coalesce(F.col(answer), F.lit(""))
    status = (
        F.when(~a.rlike(CERT_DENIED_SAID), "not_applied:no_cert_denial_language").when(F.col("decision_type") == "cert_denial", "not_applied:authorized_by_case_posture")
        .when(F.coalesce(F.col(evidence), F.lit("")).rlike(CERT_DENIED), "not_applied:authorized_by_prompt_evidence").otherwise("applied:blocked_unauthorized_cert_denial")
    )
    out = rows.withColumn("guard", status)
    instead = F.coalesce(F.nullif(tx.strip(F.coalesce(F.col(replacement), F.lit(""))), F.lit("")), F.lit(NO_SUPPORT))
    return out.withColumn("guarded_answer", F.when(F.startswith("guard", F.lit("applied")), instead).otherwise(F.col(answer)))


def upload_absence(rows: DataFrame, *, question: str, evidence: str) -> DataFrame:
    """Questions on an uploaded text that shares no core term with them: status of the absence answer."""
    core = F.array_except(tx.token_set(question, lexicon.EVIDENCE_STOPWORDS, 2), F.array(*[F.lit(w) for w in UPLOAD_GENERIC]))
    found = F.array_intersect(core, tx.token_set(F.coalesce(F.col(evidence), F.lit("")), lexicon.EVIDENCE_STOPWORDS, 2))
    return rows.withColumn(
        "absence",
        F.when(~F.col(question).rlike(UPLOAD), "not_applied:not_upload_query").when(F.col(question).rlike(COMPARING), "not_applied:comparison_query")
        .when(tx.strip(F.coalesce(F.col(evidence), F.lit(""))) == "", "not_applied:no_upload_evidence_sentences").when(F.size(core) == 0, "not_applied:no_core_query_terms")
        .when(F.size(found) > 0, "not_applied:upload_evidence_matches_query_terms").otherwise("applied:user_upload_absence"),
    )
