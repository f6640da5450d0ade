"""Persisted retrieval artifacts: chunks, postings and vectors, with a summary that names them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval

SUMMARY = "index_summary"
PARTS = ("chunks", "postings", "vectors")


def output_name(raw) -> Column:
    """Name of the chunk file of a raw file."""
    x = F.col(raw) if isinstance(raw, str) else raw
    return (
        F.when(F.endswith(x, F.lit("_cases.jsonl")), F.replace(x, F.lit("_cases.jsonl"), F.lit("_chunks.jsonl")))
        .when(F.endswith(x, F.lit(".jsonl")), F.concat(F.substring(x, F.lit(1), F.length(x) - 6), F.lit("_chunks.jsonl")))
        .otherwise(F.concat(x, F.lit("_chunks.jsonl")))
    )


def plain_metadata(columns: list[str], types: dict[str, str]) -> Column:
    """A map of the columns that are not null, as text; what is no text, number or flag becomes JSON."""
    value = lambda c: F.col(c).cast("string") if types[c] in ("string", "boolean") or types[c].startswith(("int", "bigint", "double", "float", "decimal", "smallint", "tinyint")) else F.to_json(c) if types[c].startswith(("array", "struct", "map")) else F.col(c).cast("string")
    entries = F.array(*[F.struct(F.lit(c).alias("key"), value(c).alias("value")) for c in columns])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def build(chunks: DataFrame, vectors: DataFrame, path: str, *, name: str = SUMMARY, model: str = "given") -> dict:
    """Write the chunks (chunk_id, .., text), their postings and vectors (vec_id, embedding) under ``path``.

    The summary is one JSON row beside them: counts, width, paths and time.
    """
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    kept = spark.read.parquet(f"{path}/chunks")
    retrieval.postings(kept).write.mode("overwrite").parquet(f"{path}/postings")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    shape = spark.read.parquet(f"{path}/vectors").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    n_chunks = kept.count()
    if not n_chunks:
        raise ValueError("no chunks to index")
    row = kept.limit(0).agg(F.lit(n_chunks).alias("chunk_count"), F.array(F.lit(shape["n"]), F.lit(shape["width"] or 0)).alias("embedding_shape"), F.lit(model).alias("embedding_model"), *[F.lit(f"{path}/{p}").alias(f"{p}_path") for p in PARTS], F.current_timestamp().alias("built_at"))
    row.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
    return discover(spark, path)


def resolved(root: str, value: str | None, fallback: str) -> str:
    """A path of a summary: absolute, relative to the root, or the fallback below it."""
    if value is None or not str(value).strip():
        return f"{root}/{fallback}"
    return value if value.startswith("/") or "://" in value else f"{root}/{value}"


def discover(spark: SparkSession, root: str) -> dict:
    """Paths of the artifacts under ``root``: those of the default summary, of the newest other one, else the defaults.

    Summaries are JSON folders or files that end in ``index_summary``; one that can't be
    parsed is passed over.
    """
    found = []
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root).select("path", "modificationTime", F.decode("content", "utf-8").alias("text"))
        named = F.regexp_extract("path", r"([^/]*index_summary)(?:\.json)?(?:/[^/]*)?$", 1)
        found = listed.withColumn("name", named).where("name <> ''").orderBy(F.col("name") != SUMMARY, F.desc("modificationTime"), "name").collect()  # a row for each summary
    except Exception as error:  # noqa: BLE001 - a missing folder means that there is no summary
        if "PATH_NOT_FOUND" not in str(error):
            raise
    for row in found:
        try:
            payload = json.loads(row["text"])
        except json.JSONDecodeError:
            continue
        if isinstance(payload, dict):
            return {f"{p}_path": resolved(root, payload.get(f"{p}_path"), p) for p in PARTS} | {"source": f"summary:{row['name']}"}
    return {f"{p}_path": f"{root}/{p}" for p in PARTS} | {"source": "default:index_dir"}


def added(vectors: DataFrame, more: DataFrame) -> DataFrame:
    """Vectors (vec_id, embedding) with others put in; of equal ids the new one stays."""
    return more.unionByName(vectors.join(more.select("vec_id"), "vec_id", "left_anti"))


def removed(rows: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def variant_audit(hits: DataFrame, *, by: list[str]) -> DataFrame:
    """Ids of the hits of each query variant in rank order, and the distinct documents."""
    rows = hits.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("h"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))  # hits are bounded by k
    return rows.select(*by, F.transform("h", lambda x: x["chunk_id"]).alias("chunk_ids"), "doc_ids")
