"""Evaluation: confusion counts, hit rates and expectations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text as tx

# Marks of print noise, words that go on with a sentence, and rewrites that turn a statement round.
NOISE = ["preliminary print", "reporter of decisions", "notice:", "page proof pending publication", "cite as:"]
GOES_ON = ["and ", "or ", "but ", "because ", "if ", "when ", "while ", "then ", "than ", "so "]
TURNS = [
    (" do not ", " do "), (" does not ", " does "), (" did not ", " did "), (" cannot ", " can "), (" can not ", " can "), (" are ", " are not "),
    (" is ", " is not "), (" was ", " was not "), (" were ", " were not "), (" has ", " has not "), (" have ", " have not "),
]
#: Sentences of an extractive answer are not more alike than this.
ALIKE = 0.84


def rate(n, d, digits: int = 6) -> Column:
    """n / d, and 0 where d is 0."""
    return F.round(F.when(d == 0, 0.0).otherwise(n / d), digits)


def confusion(rows: DataFrame, *, by: str) -> DataFrame:
    """Counts and rates of boolean columns actual and predicted."""
    a, p = F.col("actual"), F.col("predicted")
    c = rows.groupBy(by).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"accuracy": rate(tp + tn, tp + fp + fn + tn), "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "specificity": rate(tn, tn + fp), "f1": rate(2 * tp, 2 * tp + fp + fn)})


def hits(queries: DataFrame, ranked: DataFrame, *, query: str, cuts: tuple[int, ...] = (5,)) -> DataFrame:
    """Precision at 1, hit rates and the mean reciprocal rank of the first hit."""
    first = ranked.where("hit").groupBy(query).agg(F.min("rank").alias("first"))
    rows = queries.join(first, query, "left")
    n = F.count("*")
    share = lambda k: F.round(F.count_if(F.col("first") <= k) / n, 6)
    return rows.agg(n.alias("queries"), share(1).alias("p_at_1"), *[share(k).alias(f"hit_at_{k}") for k in cuts], F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def expectations(items: DataFrame, *, text: str, groups: Column, forbidden: Column) -> DataFrame:
    """``items`` with missing (groups without any term), forbidden_hits and passed."""
    low = F.lower(text)
    missing = F.size(F.filter(groups, lambda g: ~F.exists(g, lambda t: F.contains(low, t))))
    found = F.size(F.filter(forbidden, lambda t: F.contains(low, t)))
    out = items.withColumns({"missing": missing, "forbidden_hits": found})
    return out.withColumn("passed", (F.col("missing") == 0) & (F.col("forbidden_hits") == 0))


def by_category(checked: DataFrame, *, by: str) -> DataFrame:
    return checked.groupBy(by).agg(F.count("*").alias("items"), F.count_if("passed").alias("passed"), F.sum("missing").cast("long").alias("missing_groups"), F.sum("forbidden_hits").cast("long").alias("forbidden_hits"))


def false_positive_rate(confused: DataFrame) -> DataFrame:
    """The counts of ``confusion`` with fpr."""
    return confused.withColumn("fpr", rate(F.col("fp"), F.col("fp") + F.col("tn")))


def run_summary(cases: DataFrame, *, score: str = "score", passed: str = "passed", canonical: str = "canonical") -> DataFrame:
    """One row for a run: cases, passes, hits of canonical answers, and least, mean and greatest score."""
    return cases.agg(
        F.count("*").alias("total"), F.count_if(passed).alias("passed"), F.count_if(~F.col(passed)).alias("failed"), F.count_if(canonical).alias("canonical_hits"),
        F.min(score).alias("score_min"), F.round(F.avg(score), 6).alias("score_avg"), F.max(score).alias("score_max"),
    )


def usable_sentence(x) -> Column:
    """Sentences fit for a test answer: long enough, no print noise, a start of their own, mostly not capitals."""
    s = F.col(x) if isinstance(x, str) else x
    low = F.lower(s)
    letters, capitals = F.length(F.regexp_replace(s, r"[^\p{L}]", "")), F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    noisy, led = F.lit(False), F.lit(False)
    for mark in NOISE:
        noisy = noisy | F.contains(low, F.lit(mark))
    for word in GOES_ON:
        led = led | F.startswith(low, F.lit(word))
    return (F.length(s) >= 35) & ~noisy & ~led & ~s.rlike(r"^\p{Ll}") & (letters >= 20) & (capitals <= 0.55 * letters)


def inverted(x) -> Column:
    """A sentence that says the opposite: by the first rewrite that fits, else by a wrapper."""
    s = F.col(x) if isinstance(x, str) else x
    wrapped = F.concat(F.lit("It is not true that "), F.lower(F.regexp_replace(s, r"\.$", "")), F.lit("."))

    def turned(padded: Column, before: str, after: str) -> Column:
        at = F.instr(F.lower(padded), before)
        return F.when(at > 0, F.concat(F.substring(padded, F.lit(1), at - 1), F.lit(after), F.substring(padded, at + len(before), F.length(padded))))

    found = tx.let(F.concat(F.lit(" "), tx.strip(s), F.lit(" ")), lambda p: F.coalesce(*[turned(p, a, b) for a, b in TURNS]))
    return tx.let(tx.collapse(found), lambda t: F.coalesce(tx.terminated(t), wrapped))


def said_as_answer(sentence: str) -> str:
    """A sentence as part of an answer: without list marks and page numbers, and "Held:" spelled out."""
    sentence = re.sub(r"^Pp\.\s*\d+(?:[–-]\d+)?\.\s*", "", re.sub(r"^\([A-Za-z0-9]+\)\s+", "", sentence).strip()).strip()
    tail = sentence[5:].strip() if sentence.lower().startswith("held:") else ""
    return f"The Court held that {tail[0].lower()}{tail[1:]}" if tail else sentence


def unlike(sentences: list[str], limit: int) -> list[str]:
    """The first sentences that are not like one chosen before, by their words alone, in the form of an answer."""
    words = lambda t: " ".join(re.findall("[a-z0-9]+", t.lower()))
    kept: list[str] = []
    seen: set[str] = set()
    for one in sentences:
        if len(kept) == limit:
            break
        key = words(one)
        if key not in seen and all(SequenceMatcher(None, key, words(k)).ratio() < ALIKE for k in kept):
            kept.append(said_as_answer(one))
            seen.add(key)
    return kept


def extractive_answers(hits: DataFrame, *, query: str, limit: int = 3) -> DataFrame:
    """(query, answer, sentences): the best sentences of each question's hits that are not alike.

    ``hits``: query, query_tokens, rank, text. Scores are columns; which of the
    best are alike depends on the ones chosen, so that is a fold over each
    question's sentences, which its hits bound. A question without a usable
    sentence is answered by the start of its first hit.
    """
    sentence = F.explode(F.transform(tx.sentences("text"), lambda t: tx.terminated(tx.collapse(t))))
    rows = hits.select(query, "query_tokens", "rank", sentence.alias("sentence")).where(usable_sentence("sentence"))
    tokens = tx.token_set("sentence", lexicon.EVIDENCE_STOPWORDS, 2)
    low = F.lower("sentence")
    cue = lambda c, points: F.when(c, points).otherwise(0.0)
    has = lambda t: F.contains(low, F.lit(t))
    # Weights and cue words.
    score = (
        10.0 * F.size(F.array_intersect(tokens, "query_tokens")) / F.greatest(F.size("query_tokens"), F.lit(1)) + F.greatest(F.lit(0.0), 3.0 - F.col("rank") * 0.35)
        + cue(F.startswith(low, F.lit("held:")), 3.0) + cue(has("the court"), 1.5) + cue(has("first amendment") | has("tiktok"), 1.2) + cue(has("content neutral") | has("important government interest"), 1.0)
    )
    best = rows.where(F.size(tokens) > 0).groupBy(query).agg(F.array_sort(F.collect_set(F.struct((-score).alias("s"), "rank", "sentence"))).alias("c"))

    @F.pandas_udf("array<string>")
    def choose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([unlike(list(x), limit) for x in p])

    first = hits.groupBy(query).agg(F.min_by("text", "rank").alias("first"))
    head = tx.terminated(tx.collapse(F.substring(F.coalesce("first", F.lit("")), 1, 300)))
    picked = best.withColumn("picked", choose(F.transform("c", lambda x: x["sentence"]))).select(query, "picked")
    out = first.join(picked, query, "left").withColumn("sentences", F.coalesce(F.when(F.size("picked") > 0, F.col("picked")), F.array(head)))
    return out.select(query, F.array_join("sentences", " ").alias("answer"), "sentences")
