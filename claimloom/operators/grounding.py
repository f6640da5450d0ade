"""What a question is about: intent, follow-ups, and the resolution of its target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config, lexicon
from ..functions import names
from ..functions import text as tx


def intent(question: str, *, target: Column, citation: Column, route: Column) -> Column:
    """First of the rules that holds; a router's verdict goes before all."""
    q = F.coalesce(F.col(question), F.lit(""))
    rules = [(lexicon.AUTHOR_QUESTION, "author"), (lexicon.HOLDING_QUESTION, "holding"), (lexicon.POSTURE_QUESTION, "posture"), (lexicon.LEADS_QUESTION, "research_leads"), (lexicon.ISSUE_QUESTION, "issue_analysis")]
    out = F.when(route.isin("topic_overview", "research_leads"), route).when(route.isin("off_corpus", "clarification_needed"), "off_target")
    for pattern, name in rules:
        out = out.when(q.rlike(pattern), name)
    return out.when(citation.isNotNull(), "citation_lookup").when(target.isNotNull(), "issue_analysis").otherwise("off_target")


def depth(question: str) -> Column:
    return F.when(F.col(question).rlike(lexicon.DEPTH_QUESTION), "detailed").otherwise("concise")


def case_in(question: str) -> Column:
    return F.nullif(F.regexp_extract(question, lexicon.CASE_NAME, 1), F.lit(""))


def citation_in(question: str) -> Column:
    return F.nullif(F.regexp_extract(question, lexicon.US_CITATION, 0), F.lit(""))


def follow_ups(questions: DataFrame, state: DataFrame, *, key: str, question: str) -> DataFrame:
    """``questions`` with effective_query and status; a follow-up is put under its last target.

    ``state`` holds one row (key, last_target_case) for each conversation.
    """
    q = F.col(question)
    status = (
        F.when(tx.collapse(F.coalesce(q, F.lit(""))) == "", "not_applied:empty_query").when(case_in(question).isNotNull(), "not_applied:explicit_target")
        .when(F.col("has_state").isNull(), "not_applied:no_conversation_state").when(F.col("last_target_case").isNull(), "not_applied:no_state_target")
        .when(~q.rlike(lexicon.FOLLOW_UP), "not_applied:not_followup").otherwise("applied:conversation_state")
    )
    rewritten = F.concat(F.lit("In "), F.col("last_target_case"), F.lit(", "), F.lower(F.substring(q, 1, 1)), F.expr(f"substr({question}, 2)"))
    joined = questions.join(state.select(key, "last_target_case", F.lit(True).alias("has_state")), key, "left").withColumn("status", status)
    return joined.withColumn("effective_query", F.when(F.col("status") == "applied:conversation_state", rewritten).otherwise(q)).drop("has_state")


def most_common_name(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """The most frequent name of each group; ties go to the first seen, then by name."""
    counted = rows.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "first", name))
    return counted.withColumn("r", rank).where("r = 1").select(key, name, "n")


def _winner(scored: DataFrame, query: str, margin: float, *order: Column) -> DataFrame:
    """The best row of each query, if its score exceeds the runner-up's by the margin."""
    w = W.partitionBy(query).orderBy(*order)
    ranked = scored.withColumns({"second": F.lead("score").over(w), "r": F.row_number().over(w)})
    return ranked.where((F.col("r") == 1) & (F.col("second").isNull() | (F.col("score") > F.round(F.col("second") * margin, 6)))).drop("r", "second")


def short_name_target(hits: DataFrame, *, query: str = "query_id", margin: float = config.SHORT_NAME_MARGIN) -> DataFrame:
    """The document whose name tokens the question shares, weighted by rank.

    ``hits``: query, doc_id, rank, name_tokens, query_tokens.
    """
    overlap = F.size(F.array_intersect("name_tokens", "query_tokens"))
    scored = hits.withColumn("o", overlap).where("o > 0").groupBy(query, "doc_id").agg(F.round(F.sum(F.col("o") * (1 + 1 / F.col("rank"))), 6).alias("score"), F.min("rank").alias("best_rank"))
    return _winner(scored, query, margin, F.desc("score"), F.asc("best_rank"), F.asc("doc_id"))


def convergent_target(hits: DataFrame, *, query: str = "query_id", margin: float = config.CONVERGENT_MARGIN) -> DataFrame:
    """The family on which the first eight hits agree: two hits and two shared tokens at least.

    ``hits``: query, family, rank, shared (tokens shared with the question).
    """
    fam = hits.where("rank <= 8").groupBy(query, "family").agg(
        F.round(F.sum(1 / F.col("rank") + 0.75 * F.size("shared")), 6).alias("score"),
        F.count("*").alias("n"), F.min("rank").alias("best_rank"), F.size(F.array_distinct(F.flatten(F.collect_list("shared")))).cast("long").alias("n_shared"),
    )
    best = _winner(fam, query, margin, F.desc("score"), F.desc("n"), F.asc("best_rank"), F.asc("family"))
    return best.where("n >= 2 and n_shared >= 2")


def refusal(*, citation: Column, explicit: Column, target_found: Column, any_hits: Column, uploads: Column, intent_: Column) -> Column:
    """Why a question is refused before an answer is written, or that it isn't."""
    return (
        F.when(~any_hits & citation.isNotNull(), "not_resolved:citation_unresolved").when(citation.isNotNull() & ~target_found, "applied:explicit_citation_not_retrieved")
        .when(~any_hits, "not_applied:no_retrieval_context").when(uploads, "not_applied:user_upload_context").when(explicit.isNotNull() & ~target_found, "applied:explicit_target_not_retrieved")
        .when((intent_ != "off_target") | target_found, "not_applied:answerable_or_targeted").otherwise("applied:off_target_no_corpus_grounding")
    )


# Routes of a router that settle a question, and the least confidence.
ROUTES = ["topic_overview", "research_leads", "off_corpus", "clarification_needed"]
ROUTE_CONFIDENCE = 0.65


def route(answer: str, schema: str = "route string, confidence double") -> Column:
    """A router's answer as a struct: the whole text as JSON, else what stands between its braces; else null."""
    whole = lambda x: F.when(x.rlike(r"(?s)^\s*\{.*\}\s*$"), F.from_json(x, schema))
    text = F.coalesce(F.col(answer), F.lit(""))
    parsed = F.coalesce(whole(text), whole(F.regexp_extract(text, r"(?s)\{.*\}", 0)))
    return F.when(F.coalesce(*[parsed[f.split()[0]].cast("string") for f in schema.split(", ")]).isNotNull(), parsed)


def _matched(questions: DataFrame, hits: DataFrame, same: Column, query: str) -> DataFrame:
    """(query, target_case, target_doc_ids): the most frequent name of the matching hits, and their documents."""
    found = hits.join(questions, query).where(same)
    docs = found.groupBy(query).agg(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("target_doc_ids"))  # hits of a question are bounded
    return docs.join(most_common_name(found, query, "case_name", "rank").select(query, F.col("case_name").alias("target_case")), query, "left")


def resolve(questions: DataFrame, hits: DataFrame, *, query: str = "query_id") -> DataFrame:
    """What each question is about, by the first way that names a target.

    ``questions``: query, question, mentions_upload, route, confidence (a router's,
    or null). ``hits``: query, doc_id, rank, case_name, citation, doc_type,
    name_tokens, query_tokens, family. Ways in order: a case named in the
    question, a citation, uploads, a short name, the router, agreement of the
    first hits. One row for each question.
    """
    uploads = hits.groupBy(query).agg(F.max((F.col("doc_type") == "user_upload").cast("int")).alias("u"))
    asked = questions.join(uploads, query, "left").withColumn("uploads", F.coalesce(F.col("u"), F.lit(0)) == 1).drop("u")
    asked = asked.withColumns({"explicit_case": F.when(~(F.col("uploads") & F.col("mentions_upload")), case_in("question")), "citation_asked": citation_in("question")})
    keys = asked.select(query, "explicit_case", "citation_asked")
    own, cited = tx.compact(F.coalesce("citation", F.lit(""))), tx.compact(F.coalesce("citation_asked", F.lit("")))
    by_case = _matched(keys.where("explicit_case is not null"), hits, names.names_match(names.case_key("case_name"), names.case_key("explicit_case")), query)
    by_citation = _matched(keys.where("explicit_case is null and citation_asked is not null"), hits, names.names_match(own, cited), query)
    first_name = hits.groupBy(query, "doc_id").agg(F.min_by("case_name", "rank").alias("case_name"))
    by_short = short_name_target(hits, query=query).join(first_name, [query, "doc_id"]).select(query, F.col("case_name").alias("short_case"), F.array(F.col("doc_id").cast("string")).alias("short_docs"))
    shared = hits.withColumn("shared", F.array_intersect("name_tokens", "query_tokens"))
    of_family = hits.groupBy(query, "family").agg(F.min_by("case_name", "rank").alias("family_case"), F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("family_docs"))
    by_agreement = convergent_target(shared, query=query).join(of_family, [query, "family"]).select(query, "family_case", "family_docs")

    named = by_case.withColumnsRenamed({"target_case": "named_case", "target_doc_ids": "named_docs"})
    found = by_citation.withColumnsRenamed({"target_case": "cited_case", "target_doc_ids": "cited_docs"})
    rows = asked.join(named, query, "left").join(found, query, "left").join(by_short, query, "left").join(by_agreement, query, "left")
    routed = (F.col("confidence") >= ROUTE_CONFIDENCE) & F.lower(F.trim("route")).isin(ROUTES)
    source = (
        F.when(F.col("explicit_case").isNotNull(), "explicit_case").when(F.col("citation_asked").isNotNull(), F.when(F.col("cited_case").isNotNull(), "citation").otherwise("citation_unresolved"))
        .when(F.col("uploads"), "user_upload").when(F.col("short_case").isNotNull(), "short_name").when(routed, F.concat(F.lit("llm_route:"), F.lower(F.trim("route"))))
        .when(F.col("family_case").isNotNull(), "retrieval_convergence").otherwise("unresolved")
    )
    rows = rows.withColumn("source", source)
    pick = lambda case, cite, short, family: F.when(F.col("source") == "explicit_case", case).when(F.col("source") == "citation", F.col(cite)).when(F.col("source") == "short_name", F.col(short)).when(F.col("source") == "retrieval_convergence", F.col(family))
    rows = rows.withColumns({"target_case": pick(F.coalesce("named_case", "explicit_case"), "cited_case", "short_case", "family_case"), "docs": pick(F.col("named_docs"), "cited_docs", "short_docs", "family_docs")})
    status = F.concat(F.when(F.col("target_case").isNotNull(), "resolved:").otherwise("not_resolved:"), "source")
    out = rows.withColumns({"status": status, "target_doc_ids": F.coalesce("docs", F.expr("cast(array() as array<string>)"))})
    settled = F.when(F.startswith("source", F.lit("llm_route:")), F.lower(F.trim("route")))
    out = out.withColumn("query_intent", intent("question", target=F.col("target_case"), citation=F.col("citation_asked"), route=F.coalesce(settled, F.lit(""))))
    return out.select(query, "status", "source", "target_case", F.col("citation_asked").alias("target_citation"), "target_doc_ids", "explicit_case", "query_intent", F.col("uploads").alias("has_user_upload_context"))


def missing_cases(grounded: DataFrame, hits: DataFrame, *, query: str = "query_id") -> DataFrame:
    """(query, missing_case): named cases that no hit of their question is about."""
    named = grounded.where("explicit_case is not null").select(query, F.coalesce("target_case", "explicit_case").alias("missing_case"))
    there = hits.select(query, "case_name").join(named, query).where(names.names_match(names.case_key("case_name"), names.case_key("missing_case"))).select(query)
    return named.join(there, query, "left_anti")
