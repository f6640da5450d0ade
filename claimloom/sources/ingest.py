"""Ingestion: incremental sync, upserts, best texts, repeated page lines, JSONL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

DOCUMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "doc_type", "case_name", "citation", "court", "court_level", "date_decided", "full_text")]
    + [T.StructField("title", T.IntegerType()), T.StructField("section", T.StringType()), T.StructField("source_file", T.StringType()), T.StructField("is_privileged", T.BooleanType())]
)
#: Columns of an opinion that may hold its text, in order of preference. Fixed values.
TEXT_FIELDS = ("plain_text", "html_with_citations", "html", "html_lawbox", "html_columbia", "xml_harvard")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSONL documents; malformed lines fail, dates that are none become null."""
    raw = spark.read.schema(DOCUMENT).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(path)
    return raw.withColumns({"date_decided": F.expr("try_to_date(date_decided)"), "is_privileged": F.coalesce("is_privileged", F.lit(False))})


def known_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string").option("mode", "DROPMALFORMED").json(path).where("id is not null").distinct()


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert by key: the last version wins; ``first_seen`` keeps the first one's order."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), version).alias("row"), F.min(version).alias("first_seen")).select(key, *[F.col(f"row.{c}").alias(c) for c in columns], "first_seen")


def sync_counts(rows: DataFrame, known: DataFrame, *, key: str, modified: str, since: Column, by: str) -> DataFrame:
    """New and updated keys among the rows modified since a time."""
    fresh = rows.where(F.col(modified) >= since).groupBy(by, key).agg(F.count("*").alias("rows"))
    seen = known.select(key).distinct().withColumn("seen", F.lit(True))
    return fresh.join(seen, key, "left").groupBy(by).agg(
        F.sum("rows").cast("long").alias("fetched"), F.count_if(F.col("seen").isNull()).alias("new"), F.count_if(F.col("seen").isNotNull()).alias("updated")
    )


def opinion_text(fields: dict[str, bool]) -> Column:
    """The first field that isn't blank; fields marked True are HTML."""
    return F.coalesce(*[F.nullif(tx.strip_html(c) if html else tx.strip(c), F.lit("")) for c, html in fields.items()])


def repeated_lines(pages: DataFrame, *, doc: str, page: str, lines: str, one_in: int = 2) -> DataFrame:
    """First and last lines of pages that stand on enough pages of their document.

    Enough is more than one page in ``one_in``, two pages at least; longer lines
    than 80 characters don't count.
    """
    ends = pages.select(doc, page, F.explode(F.array_distinct(F.array(F.element_at(lines, 1), F.element_at(lines, -1)))).alias("line")).where("length(line) between 1 and 80")
    total = pages.groupBy(doc).agg(F.count_distinct(page).alias("pages"))
    counted = ends.groupBy(doc, "line").agg(F.count_distinct(page).alias("n"))
    return counted.join(total, doc).where(f"n >= greatest(2, cast(floor(pages / {one_in}) as long) + 1)").select(doc, "line", "n")


def summary(chunks: DataFrame, file: str) -> DataFrame:
    return chunks.groupBy(file).agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"))


def uploads(docs: DataFrame, chunks: DataFrame, *, key: str) -> DataFrame:
    """Documents with their size and number of chunks, 0 where there is none."""
    counts = chunks.groupBy(key).agg(F.count("*").alias("chunk_count"))
    return docs.select(key, F.length("text").cast("long").alias("size")).join(counts, key, "left").select(key, F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
