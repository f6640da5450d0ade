"""Query expansion by rules and corpus facets, as expressions over all questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config, lexicon
from ..functions import text as tx


def _named(x: Column) -> Column:
    return x.rlike(tx.ascii_bounds(lexicon.NAMED_CASE)) | x.rlike(tx.ascii_bounds(lexicon.REPORTER))


def plans(questions: DataFrame, *, mode: str = "hybrid", max_terms: int = config.MAX_TERMS, max_variants: int = config.MAX_VARIANTS) -> DataFrame:
    """``questions`` (query, optional facets array) with terms, variants and status."""
    q = tx.collapse(F.coalesce("query", F.lit("")))
    low = F.lower(q)
    broad = (F.size(F.regexp_extract_all(low, F.lit("[a-z0-9][a-z0-9'-]*"), F.lit(0))) >= 3) & low.rlike(tx.ascii_bounds(lexicon.AUTHORITY_SEEKING))
    parts = [F.array(*[F.lit(t) for t in lexicon.AUTHORITY_TERMS])]
    for triggers, terms in lexicon.EXPANSIONS:
        hit = F.lit(False)
        for t in triggers:
            hit = hit | F.contains(low, F.lit(t))
        parts.append(F.when(hit, F.array(*[F.lit(t) for t in terms])).otherwise(F.array().cast("array<string>")))
    if mode != "rule" and "facets" in questions.columns:
        parts.append(F.coalesce("facets", F.array().cast("array<string>")))
    named, gate = _named(q), F.lit(mode.lower() in ("raw", "none", "off", "disabled"))
    status = F.when(q == "", "not_applied:blank_query").when(gate, "not_applied:mode_disabled").when(named, "not_applied:named_authority_query").when(~broad, "not_applied:not_broad_research_query")
    out = questions.withColumns({"query": q, "status": status.otherwise("applied")})
    terms = F.slice(F.filter(F.array_distinct(F.concat(*parts)), lambda t: (t != "") & ~F.contains(F.lower("query"), t) & ~_named(t)), 1, max_terms)
    out = out.withColumn("terms", F.when(F.col("status") == "applied", terms).otherwise(F.array().cast("array<string>")))
    n = F.size("terms")
    batch = F.greatest(F.lit(3), F.least(F.lit(5), n))
    starts = F.slice(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), batch), 1, max_variants - 1)
    variants = F.transform(starts, lambda s: F.concat(F.col("query"), F.lit(" "), F.array_join(F.slice("terms", s + 1, batch), " ")))
    out = out.withColumn("variants", F.when(n > 0, F.array_distinct(F.concat(F.array("query"), variants))).otherwise(F.array("query")))
    return out.withColumn("status", F.when((F.col("status") == "applied") & (n == 0), "not_applied:no_safe_expansions").otherwise(F.col("status")))


def facet_terms(rows: DataFrame, *, query: str, rank: str) -> DataFrame:
    """(query, facets): level, court, type and title or section terms of the first eight hits."""
    clean = lambda c: F.trim(F.regexp_replace(F.lower(F.replace(F.col(c).cast("string"), F.lit("_"), F.lit(" "))), r"\s+", " "))
    kind = F.when(clean("doc_type").isin("case", "statute", "regulation"), clean("doc_type"))
    found = F.array_compact(F.array(F.nullif(clean("court_level"), F.lit("")), F.nullif(clean("court"), F.lit("")), kind))
    listed = rows.where(F.col(rank) <= 8).select(query, F.struct(F.col(rank).alias("r"), found.alias("f")).alias("s")).groupBy(query).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return listed.select(query, F.array_distinct(F.flatten(F.transform("s", lambda x: x["f"]))).alias("facets"))
