"""The corpus job: raw JSONL files to chunk folders, one for each file, and a summary.

A file that has not changed since the last run (same length and time) is not
read; the folder of one that changed is replaced, that of one that is gone is
removed. The state is a Parquet table beside the chunks, written last, so a run
that failed is done again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import chunking
from ..sources import index, ingest, versions
from ..storage import written

#: Columns of a document that its chunks keep.
KEPT = ("doc_type", "case_name", "citation", "court", "court_level", "date_decided", "title", "section", "source_file")
_FILES = "path string, name string, length long, modified timestamp"


def raw_files(spark: SparkSession, raw: str) -> DataFrame:
    """(path, name, length, modified) of the JSONL files of a folder."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(raw)
    return listed.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def _drop(spark: SparkSession, folder: str) -> None:
    fs, at, _ = versions._fs(spark, folder)
    fs.delete(at, True)


def prepare(spark: SparkSession, raw: str, out: str, *, size: int = config.CHUNK_WORDS, overlap: int = config.CHUNK_OVERLAP) -> DataFrame:
    """Bring ``out/chunks`` up to date with the files of ``raw``; returns the summary by file.

    (name, output_file, documents, chunks, changed); ``out/summary`` has the
    totals as one JSON row. No file at all is an error.
    """
    now = written(raw_files(spark, raw), "raw-files")
    if now.isEmpty():
        raise ValueError(f"no JSONL files under {raw}")
    states = versions.latest(spark, f"{out}/state")
    before = spark.read.parquet(f"{out}/state/{states['folder']}") if states else spark.createDataFrame([], f"{_FILES}, size int, overlap int, output_file string, documents long, chunks long")
    settings = (F.col("size") == size) & (F.col("overlap") == overlap)
    same = now.join(before.where(settings), ["path", "name", "length", "modified"], "left_semi").select("path")
    changed = now.join(same, "path", "left_anti").withColumn("output_file", index.output_name("name"))
    gone = before.join(now, "name", "left_anti").select("output_file")
    # names of files: the driver lists them anyway
    paths = [(r["path"], r["output_file"]) for r in changed.collect()]
    for folder in {f for _, f in paths} | {r["output_file"] for r in gone.collect()}:
        _drop(spark, f"{out}/chunks/output_file={folder}")
    done = before.where("false").select("name", "documents", "chunks")
    if paths:
        docs = ingest.read_documents(spark, [p for p, _ in paths])
        docs = docs.select("id", F.col("full_text").alias("text"), *KEPT, F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("name"))
        chunks = chunking.word_windows(docs, size=size, overlap=overlap, key="id", keep=(*KEPT, "name")).withColumn("output_file", index.output_name("name"))
        chunks.drop("name").write.mode("append").partitionBy("output_file").json(f"{out}/chunks")
        made = chunks.sparkSession.read.schema("id string, output_file string").json(f"{out}/chunks").groupBy("output_file").agg(F.count("*").alias("chunks"))
        counted = docs.groupBy("name").agg(F.count("*").alias("documents")).withColumn("output_file", index.output_name("name"))
        done = counted.join(made, "output_file", "left").select("name", "documents", F.coalesce("chunks", F.lit(0)).alias("chunks"))
    fresh = changed.join(done, "name", "left").select("path", "name", "length", "modified", F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), "output_file", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    old = before.join(same, "path", "left_semi").select(*fresh.columns)
    number = (states["version"] + 1) if states else 0
    fresh.withColumn("changed", F.lit(True)).unionByName(old.withColumn("changed", F.lit(False))).coalesce(1).write.mode("overwrite").parquet(f"{out}/state/v{number}")
    versions.commit(spark, f"{out}/state", states, {"folder": f"v{number}"})
    state = spark.read.parquet(f"{out}/state/v{number}")
    total = state.agg(F.array_sort(F.collect_list("name")).alias("raw_files"), F.sum("documents").alias("documents_loaded"), F.sum("chunks").alias("chunks_written"), F.array_sort(F.collect_list("output_file")).alias("output_files"))
    one = F.when(F.size("output_files") == 1, F.get("output_files", F.lit(0)))
    total.select(F.lit(raw).alias("raw_dir"), F.lit(f"{out}/chunks").alias("processed_dir"), "*", one.alias("output_file")).coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    return state.select("name", "output_file", "documents", "chunks", "changed")


def summary(spark: SparkSession, out: str) -> dict:
    """The totals of the last run."""
    return json.loads(spark.read.text(f"{out}/summary").first()[0])


def load_chunks(spark: SparkSession, out: str) -> DataFrame:
    """All chunks of a prepared corpus with the columns of their documents; rows that are no JSON fail."""
    kept = ", ".join(f"{c} {'int' if c == 'title' else 'date' if c == 'date_decided' else 'string'}" for c in KEPT)
    return spark.read.schema(f"id string, chunk_index long, chunk_id string, text string, {kept}, output_file string").option("mode", "FAILFAST").json(f"{out}/chunks")
