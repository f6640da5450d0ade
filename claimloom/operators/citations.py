"""Citations in text, what is claimed under them, and whether the cited source bears it out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as tx
from ..storage import spread, written
from . import containment

# Patterns of reporters, of code sections, of case names, and of signal words.
CASE_CITATION = r"(?i)\b(\d+)\s+(U\.?\s*S\.?|S\.?\s*Ct\.?|F\.?\s*3d|F\.?\s*2d|F\.?\s*Supp\.?\s*\d*)\s+(\d+)\b"
CODE_CITATION = r"(?i)\b(\d+)\s+U\.?\s*S\.?\s*C\.?\s*(?:§+\s*)?([\w\-.]+)\b"
CITED_CASE = r"([A-Z][\w'&.-]+(?:\s+[A-Z][\w'&.-]+)*)\s+v\.?\s+([A-Z][\w'&.-]+(?:\s+[A-Z][\w'&.-]+)*)"
SIGNAL = r"(?i)\b(?:see|under|cf\.?|accord|citing)\b"
#: Characters before a citation in which its case name is looked for.
NAME_WINDOW = 120
# Least scores of a verified and of a weak citation.
VERIFIED, WEAK = 0.75, 0.55
_OPEN, _CLOSE = "\u0001", "\u0002"


def key(x) -> Column:
    """Letters and digits in capitals: the form in which citations are compared."""
    return F.upper(F.regexp_replace(F.coalesce(tx._c(x), F.lit("")), "[^A-Za-z0-9]", ""))


def _found(text: Column, pattern: str, build: Callable[[Column, Column, Column], Column]) -> Column:
    """``build(raw match, offset, text before)`` of every match.

    Matches are marked in the text, which is then cut at the marks; offsets are
    sums of the lengths of the parts. A part before a match has eight characters
    at least, so thirty parts hold the window before it.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, "  ")
    whole = lambda p: F.replace(p, F.lit(_CLOSE), F.lit(""))

    def cut(parts: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            at = F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0).cast("long"), lambda n, p: n + F.length(whole(p)))
            first = F.greatest(F.lit(1), i - 29)
            before = whole(F.array_join(F.slice(parts, first, i - first + 1), ""))
            return tx.let(F.substring_index(part, _CLOSE, 1), lambda raw: build(raw, at, F.right(before, F.lit(NAME_WINDOW))))

        return F.transform(parts, lambda p, i: F.when(i > 0, one(p, i)))

    return F.array_compact(tx.let(F.split(F.regexp_replace(plain, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN), cut))


def _last_case(before: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(F.try_element_at(F.regexp_extract_all(before, F.lit(CITED_CASE), F.lit(0)), F.lit(-1)), F.lit(""))), F.lit(""))


def extracted(text) -> Column:
    """All citations of a text in their order: at, type, raw_text, normalized_text, case_name and their parts."""
    none = F.lit(None).cast("string")

    def case(raw: Column, at: Column, before: Column) -> Column:
        volume, page = F.regexp_extract(raw, CASE_CITATION, 1), F.regexp_extract(raw, CASE_CITATION, 3)
        reporter = names.reporter(F.regexp_extract(raw, CASE_CITATION, 2))
        said = F.concat_ws(" ", volume, reporter, page)
        return F.struct(at.alias("at"), F.lit("case").alias("type"), said.alias("raw_text"), key(said).alias("normalized_text"), _last_case(before).alias("case_name"), volume.alias("volume"), reporter.alias("reporter"), page.alias("page"), none.alias("title"), none.alias("section"))

    def code(raw: Column, at: Column, before: Column) -> Column:
        title, section = F.regexp_extract(raw, CODE_CITATION, 1), F.regexp_extract(raw, CODE_CITATION, 2)
        said = F.concat(title, F.lit(" U.S.C. § "), section)
        return F.struct(at.alias("at"), F.lit("statute").alias("type"), said.alias("raw_text"), key(said).alias("normalized_text"), none.alias("case_name"), none.alias("volume"), none.alias("reporter"), none.alias("page"), title.alias("title"), section.alias("section"))

    x = tx._c(text)
    return F.array_sort(F.concat(_found(x, CASE_CITATION, case), _found(x, CODE_CITATION, code)))


def proposition(text, citations) -> Column:
    """The text without its citations, their case names, years, signal words and commas."""
    bare = F.aggregate(
        tx._c(citations), F.coalesce(tx._c(text), F.lit("")),
        lambda t, c: F.replace(F.when(c["case_name"].isNotNull(), F.replace(t, c["case_name"], F.lit(" "))).otherwise(t), c["raw_text"], F.lit(" ")),
    )
    for pattern in (r"\(\d{4}\)", SIGNAL, ","):
        bare = F.regexp_replace(bare, pattern, " ")
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[ .;:\-,]+|[ .;:\-,]+$", "")


def token_cosine(a: str, b: str) -> Column:
    """Cosine of the token sets of two texts: stands in for vectors of a model."""
    x, y = (F.array_distinct(F.filter(F.split(tx.compact_words(c), " "), lambda t: t != "")) for c in (a, b))
    return F.round(F.size(F.array_intersect(x, y)) / F.sqrt(F.greatest(F.size(x) * F.size(y), F.lit(1)).cast("double")), 6)


def support(score: Column) -> Column:
    return F.when(score >= VERIFIED, "VERIFIED").when(score >= WEAK, "WEAK").otherwise("UNSUPPORTED")


def score_label(score: Column, high: Column, middle: Column) -> Column:
    """Label of a similarity under the thresholds of ``verification.citation_thresholds``."""
    return F.when(score >= high, "SUPPORTED").when(score >= middle, "PARTIAL").otherwise("NOT SUPPORTED")


def candidates(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(citation_key, chunk_id): chunks cited by that key, or whose text holds it.

    Each chunk's text is read once, whatever the number of keys.
    """
    keys = written(asked.where("citation_key <> ''").select("citation_key").distinct(), "citation-keys")
    texts = chunks.select("chunk_id", key("citation").alias("citation_key"), key("text").alias("text"))
    own = texts.join(keys, "citation_key").select("citation_key", "chunk_id")
    held = containment.contained(texts.select(F.col("chunk_id").alias("text_id"), "text"), keys.select(F.col("citation_key").alias("key")))
    return own.unionByName(held.select(F.col("key").alias("citation_key"), F.col("text_id").alias("chunk_id"))).distinct()


def verify(claims: DataFrame, chunks: DataFrame, *, score: Callable[[str, str], Column] = token_cosine) -> DataFrame:
    """One row for each claim (claim_id, text) against (chunk_id, doc_id, citation, text).

    The first citation of a claim is looked up; of the chunks that match it the
    one most like the claimed proposition decides, equal ones by chunk_id.
    """
    parsed = spread(claims).select("claim_id", "text", extracted("text").alias("citations"))
    parsed = parsed.select("claim_id", F.size("citations").cast("long").alias("n_citations"), F.get("citations", F.lit(0)).alias("first"), proposition("text", "citations").alias("proposition"))
    asked = parsed.select("claim_id", "n_citations", "proposition", F.col("first.raw_text").alias("raw_text"), F.coalesce("first.normalized_text", F.lit("")).alias("citation_key"))
    asked = written(asked, "parsed-claims")
    # equal chunks stand behind the first of them, equal questions are asked once: what is rated are pairs of different texts
    alike = chunks.where("chunk_id is not null").groupBy("citation", "text").agg(F.min(F.struct("chunk_id", "doc_id")).alias("least"), F.count("*").alias("n"))
    alike = written(alike.select("least.*", "citation", "text", "n"), "alike-chunks")
    questions = asked.where("citation_key <> ''").select("citation_key", "proposition").distinct()
    pairs = questions.join(candidates(asked, alike), "citation_key").join(alike.select("chunk_id", "doc_id", "n", F.col("text").alias("evidence")), "chunk_id")
    rated = pairs.withColumn("score", F.when(F.col("proposition") == "", 1.0).otherwise(score("proposition", "evidence")))
    # without a proposition the first match stands for all, as all have the same score
    first = F.min(F.struct((-F.col("score")).alias("s"), "chunk_id", "doc_id", F.substring("evidence", 1, 300).alias("evidence"))).alias("first")
    best = rated.groupBy("citation_key", "proposition").agg(first, F.sum("n").alias("n_candidates"))
    best = best.select("citation_key", "proposition", "first.chunk_id", "first.doc_id", (-F.col("first.s")).alias("score"), "n_candidates", "first.evidence")
    out = asked.join(best, ["citation_key", "proposition"], "left")
    verdict = F.when(F.col("chunk_id").isNull(), "CITATION_ERROR").when(F.col("proposition") == "", "VERIFIED").otherwise(support(F.col("score")))
    why = (
        F.when(F.col("n_citations") == 0, "No legal citation found in claim text.").when(F.col("chunk_id").isNull(), F.concat(F.lit("No retrieved source matches citation "), "raw_text", F.lit(".")))
        .when(F.col("proposition") == "", "Citation matched retrieved authority.")
        .when(F.col("score") >= VERIFIED, F.concat(F.lit("Citation "), "raw_text", F.lit(" matched the retrieved authority and supports the proposition.")))
        .when(F.col("score") >= WEAK, F.concat(F.lit("Citation "), "raw_text", F.lit(" matched the authority, but support for the proposition is limited.")))
        .otherwise(F.concat(F.lit("Citation "), "raw_text", F.lit(" matched the authority, but the retrieved text does not support the proposition.")))
    )
    return out.select(
        "claim_id", "n_citations", "raw_text", "proposition", (F.col("n_citations") > 0).alias("format_valid"), F.col("chunk_id").isNotNull().alias("authority_found"),
        "chunk_id", "doc_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.round(F.coalesce("score", F.lit(0.0)), 3).alias("confidence"), "evidence", verdict.alias("verdict"), why.alias("explanation"),
    )


def best_chunk(claims: DataFrame, chunks: DataFrame, *, score: Callable[[str, str], Column] = token_cosine) -> DataFrame:
    """(claim_id, chunk_id, score): the chunk of its own source that is most like each claim.

    ``claims``: claim_id, source, text. ``chunks``: source, chunk_id, text.
    """
    pairs = claims.select("claim_id", "source", F.col("text").alias("claim")).join(chunks.select("source", "chunk_id", F.col("text").alias("evidence")), "source")
    rated = pairs.withColumn("score", score("claim", "evidence"))
    order = W.partitionBy("claim_id").orderBy(F.desc("score"), "chunk_id")
    return rated.withColumn("r", F.row_number().over(order)).where("r = 1").select("claim_id", "chunk_id", "score")
