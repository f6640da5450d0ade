"""Incremental ingestion: new JSONL files upserted into a table, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import DOCUMENT, latest


def documents(spark: SparkSession, path: str, *, files_per_batch: int = 1000) -> DataFrame:
    """A stream of raw documents; ``version`` orders the files they came in."""
    stream = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.jsonl").json(path)
    return stream.where("id is not null").withColumn("version", F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file")))


def sync(stream: DataFrame, table: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Write the last version of each id, one partition of the table for each batch.

    A batch that is repeated after a failure overwrites its own partition, so
    every file counts once. ``current`` reads the newest version of each id.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = latest(batch, "id", "version").drop("first_seen")
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    return latest(spark.read.parquet(table), "id", "version").drop("first_seen")
