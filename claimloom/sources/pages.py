"""Text of paged documents (one row for each page or block): lines, paragraphs, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Lines that are page furniture, headings, or parts of a docket.
ARTIFACT = r"(?i)^(?:page\s+)?\d+(?:\s+of\s+\d+)?$|^(?:-\s*)?\d+(?:\s*-)?$"
HEADING = r"^[A-Z][A-Z0-9 .,'&()/-]+$"
SECTION = r"(?i)^(?:section|article|chapter|part|title|appendix|introduction|background|discussion|conclusion|analysis|facts|holding)\b"
DOCKET = r"(?i)\b(?:no\.?|case\s+no\.?|docket\s+no\.?)\s+[\w:\-./]+\b"
LINE_CITATION = r"\b\d{1,4}\s+[A-Z][A-Za-z.\d]*\s+\d{1,5}\b"
LINE_DATE = r"(?i)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2},\s+\d{4}\b"
BULLET = r"^(?:[-*•]|\(?[0-9a-zA-Z]{1,3}[.)])\s"


def normalize_block(x: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(x, "­", ""), r"\r\n?|\f", "\n")
    return tx.strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def page_text(blocks: DataFrame, *, doc: str, page: str) -> DataFrame:
    """(doc, page, text) from blocks (doc, page, x, y, text), top down and left to right."""
    key = F.struct(F.round("y", 1).alias("y"), F.round("x", 1).alias("x"), normalize_block(F.col("text")).alias("t"))
    grouped = blocks.groupBy(doc, page).agg(F.array_sort(F.collect_list(key)).alias("b"))
    return grouped.select(doc, page, F.array_join(F.filter(F.transform("b", lambda x: x["t"]), lambda t: t != ""), "\n\n").alias("text"))


def is_artifact(line: Column) -> Column:
    return (line == "") | line.rlike(ARTIFACT) | ((F.length(line) <= 4) & line.rlike("[0-9]"))


def is_heading(line: Column) -> Column:
    return (F.length(line) <= 120) & (line.rlike(HEADING) | line.rlike(SECTION))


def synopsis(text, limit: int = 1200) -> Column:
    """Headings and the lines with a docket number, a citation or a date, until ``limit``
    characters are reached, cut there; without any, the start of the text."""
    clean = lambda x: F.regexp_replace(tx.collapse(F.replace(x, F.lit("\u00ad"), F.lit(""))), r"^[ |]+|[ |]+$", "")
    x = F.coalesce(tx._c(text), F.lit(""))
    told = lambda line: (line != "") & (is_heading(line) | line.rlike(DOCKET) | line.rlike(LINE_CITATION) | line.rlike(LINE_DATE))
    lines = F.filter(F.transform(F.split(x, r"\r\n|\r|\n"), clean), told)
    empty = F.struct(F.expr("cast(array() as array<string>)").alias("kept"), F.lit(0).alias("n"))
    step = lambda a, line: F.when(a["n"] >= limit, a).otherwise(F.struct(F.concat(a["kept"], F.array(line)).alias("kept"), (a["n"] + F.length(line) + 1).alias("n")))
    kept = F.aggregate(lines, empty, step)["kept"]
    return tx.let(kept, lambda k: F.when(F.size(k) > 0, tx.strip(F.substring(F.array_join(k, "\n"), 1, limit))).otherwise(F.substring(clean(F.substring(x, 1, limit)), 1, limit)))


def _merge(lines: Column) -> Column:
    """Lines folded into paragraphs: a break after an end mark and around headings and bullets."""

    def step(acc: Column, line: Column) -> Column:
        last = F.element_at(acc, -1)
        rest = F.slice(acc, 1, F.size(acc) - 1)
        apart = last.rlike(r"""[.!?:]["')\]]?$""") | is_heading(last) | is_heading(line) | line.rlike(BULLET)
        broken = last.rlike(r"\w-$") & line.rlike("^[a-z]")
        joined = F.when(broken, F.concat(F.expr("substr('', 1)"), F.regexp_replace(last, "-$", ""), line)).otherwise(F.concat_ws(" ", last, line))
        return F.when((F.size(acc) == 0) | apart, F.concat(acc, F.array(line))).otherwise(F.concat(rest, F.array(joined)))

    return F.aggregate(lines, F.array().cast("array<string>"), step)


def assemble(pages: DataFrame, *, doc: str, page: str) -> DataFrame:
    """(doc, text, title): pages without repeated first and last lines, joined in order."""
    lines = pages.select(doc, page, F.filter(F.transform(F.split("text", "\n"), tx.strip), lambda x: x != "").alias("lines"))
    ends = lines.select(doc, page, F.explode(F.array_distinct(F.array(F.get("lines", F.lit(0)), F.element_at(F.concat(F.array(F.lit("")), "lines"), -1)))).alias("line")).where("line <> ''")
    n = lines.groupBy(doc).agg(F.count_distinct(page).alias("pages"))
    often = ends.groupBy(doc, "line").agg(F.count_distinct(page).alias("n")).join(n, doc).where("n >= greatest(2, cast(floor(pages / 2) as long) + 1)")
    gone = often.where(is_artifact(F.col("line")) | (F.length("line") <= 80)).groupBy(doc).agg(F.collect_set("line").alias("gone"))
    kept = lines.join(gone, doc, "left").select(doc, page, F.filter("lines", lambda x: ~F.coalesce(F.array_contains("gone", x), F.lit(False)) & ~is_artifact(x)).alias("lines"))
    merged = kept.select(doc, page, _merge(F.col("lines")).alias("paragraphs"))
    whole = merged.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, "paragraphs"))).alias("p"))
    flat = F.flatten(F.transform("p", lambda x: x["paragraphs"]))
    titled = F.filter(F.slice(flat, 1, 12), lambda x: F.length(x).between(6, 160) & (is_heading(x) | F.contains(x, F.lit(" v. ")) | ((F.initcap(x) == x) & (F.size(F.split(x, " ")) >= 2))))
    return whole.select(doc, F.array_join(flat, "\n\n").alias("text"), F.get(titled, F.lit(0)).alias("title"))


def read_uploads(spark, path: str) -> DataFrame:
    """Plain text and Markdown files below a folder: (document_id, source_file, case_name, text); empty ones go."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").text(path)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1)
    rows = files.select(name.alias("source_file"), tx.strip("value").alias("text")).where("text <> ''")
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    return rows.select(tx.upload_id("source_file", "text").alias("document_id"), "source_file", tx.collapse(F.regexp_replace(stem, "[_-]+", " ")).alias("case_name"), "text")
