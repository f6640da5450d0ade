"""Prompt text for generators: context, history, posture, and marked-up answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def context(chunks: DataFrame, *, by: str, order: str) -> DataFrame:
    """(by, context): numbered items of allowed facts; blank ones are left out."""
    rows = chunks.where(tx.strip(F.coalesce("text", F.lit(""))) != "").groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, tx.strip("text").alias("t")))).alias("c"))
    item = lambda x, i: F.concat(
        F.lit("Context item "), (i + 1).cast("string"), F.lit(":\n"),
        F.when(x["t"].contains("Allowed answer fact:") | x["t"].contains("Evidence type:"), x["t"]).otherwise(F.concat(F.lit("Evidence type: allowed answer fact\nAllowed answer fact: "), x["t"])),
    )
    return rows.select(by, F.array_join(F.transform("c", item), "\n\n").alias("context"))


def history(messages: DataFrame, *, by: str, order: str) -> DataFrame:
    """(by, history): one line a message with its role; blank ones are left out."""
    line = F.concat(F.when(F.col("role") == "assistant", "Assistant").otherwise("User"), F.lit(": "), tx.collapse("text"))
    rows = messages.where(tx.collapse(F.coalesce("text", F.lit(""))) != "").groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))).alias("m"))
    return rows.select(by, F.array_join(F.transform("m", lambda x: x["l"]), "\n").alias("history"))


def posture_lines(case: str) -> Column:
    """The posture columns of a row as labelled lines with their constraints."""
    labels = [("Target case", F.col(case)), ("Decision type", F.col("decision_type")), ("Court action", F.col("court_action")), ("Opinion role", F.col("opinion_role")), ("Opinion author", F.col("author")), ("Separate opinion", F.when(F.col("is_separate"), "yes").otherwise("no"))]
    lines = [F.lit("Structured case posture derived from the retrieved context:"), *[F.concat(F.lit(f"{n}: "), F.replace(F.nullif(v, F.lit("")), F.lit("_"), F.lit(" "))) for n, v in labels]]
    lines.append(F.when(F.col("decision_type") == "cert_denial", "Constraint: state that the Court denied certiorari before describing any separate opinion."))
    lines.append(F.when(F.col("opinion_role").rlike("^(?:dissent|concurrence)"), "Constraint: do not describe the separate opinion as the Court's holding."))
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n\n"))


def escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def annotated(answers: DataFrame, blocks: DataFrame, *, by: str) -> DataFrame:
    """(by, html): the answer with a span of its support around each claim block.

    ``blocks``: by, start, end (from 0), support_level, claim_count; no overlaps.
    """
    claims = blocks.where("claim_count > 0").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("start", "end", "support_level"))).alias("b"))
    rows = answers.join(claims, by, "left").withColumn("b", F.coalesce("b", F.expr("cast(array() as array<struct<start: bigint, end: bigint, support_level: string>>)")))
    cut = lambda a, b: escaped(F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    start = F.struct(F.lit("").alias("html"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, x: F.struct(
        F.concat(acc["html"], cut(acc["at"], x["start"]), F.lit('<span class="claim-'), F.replace(x["support_level"], F.lit("_"), F.lit("-")), F.lit('">'), cut(x["start"], x["end"]), F.lit("</span>")).alias("html"),
        x["end"].alias("at"),
    )
    done = rows.withColumn("f", F.aggregate("b", start, step))
    return done.select(by, F.concat(F.col("f.html"), cut(F.col("f.at"), F.length("text").cast("long"))).alias("html"))
