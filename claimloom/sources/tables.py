"""The store's tables on disk: versions, inserts with allocated ids, changes that are committed as one.

A manifest names the files of every table and the next free id. An insert writes
its rows with numbers from 0 and its commit gives the range they stand in, so of
two writers that started from one version the one that comes second only asks
for another range: no row is lost and no id is given twice. A change that
depends on what is stored (``change``) is computed again from the new version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import store
from ..storage import written
from . import versions


def create(spark: SparkSession, path: str) -> dict:
    """A store of empty tables."""
    return versions.commit(spark, path, None, {"tables": {t: [] for t in store.TABLES}, "next": {t: 1 for t in store.TABLES}})


def read(spark: SparkSession, path: str, table: str, manifest: dict | None = None) -> DataFrame:
    """A table as of the last version, or of a given one."""
    manifest = manifest or versions.latest(spark, path)
    out = spark.createDataFrame([], store.TABLES[table])
    for part in manifest["tables"][table]:
        rows = spark.read.schema(store.TABLES[table]).parquet(f"{path}/{part['folder']}")
        out = out.unionByName(rows.withColumn("id", F.col("id") + part["base"]) if part["base"] is not None else rows)
    return out


def numbered(rows: DataFrame, column: str = "id") -> DataFrame:
    """Rows with whole numbers from 0 without gaps; the driver sees one count for each task."""
    held = written(rows, "numbered")
    placed = written(held.withColumn("at_", F.monotonically_increasing_id()), "placed")
    task = F.shiftright("at_", 33)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(task.alias("task")).count().collect())
    offsets, total = {}, 0
    for t, n in counts:
        offsets[t], total = total, total + n
    if not offsets:
        return placed.drop("at_").withColumn(column, F.lit(0).cast("long"))
    known = placed.sparkSession.createDataFrame(list(offsets.items()), "task_ long, offset_ long")
    met = placed.withColumn("task_", task).join(F.broadcast(known), "task_")  # a row for each task
    return met.withColumn(column, F.col("offset_") + F.col("at_").bitwiseAND((1 << 33) - 1)).drop("at_", "task_", "offset_")


def insert(rows: DataFrame, path: str, table: str) -> tuple[int, int]:
    """Append rows; their ids are a free range: (first id, number of rows). Given ids are not used."""
    spark, folder = rows.sparkSession, f"{table}/{uuid.uuid4().hex}"
    keyed = "id" in store.TABLES[table].fieldNames()
    plain = rows.drop("id")
    store.conform(numbered(plain) if keyed else plain, table).write.parquet(f"{path}/{folder}")
    n = spark.read.parquet(f"{path}/{folder}").count()
    taken: list[int] = []

    def change() -> dict:
        old = versions.latest(spark, path)
        base = old["next"][table]
        taken[:] = [base]
        part = {"folder": folder, "base": base if keyed else None}
        return versions.commit(spark, path, old, {"tables": {**old["tables"], table: [*old["tables"][table], part]}, "next": {**old["next"], table: base + n}})

    versions.retried(change, 100)
    return taken[0], n


def change(spark: SparkSession, path: str, names: list[str], use: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> dict:
    """Replace tables by what ``use`` makes of them, all or none; run again if another writer came first."""

    def once() -> dict:
        old = versions.latest(spark, path)
        made = use({n: read(spark, path, n, old) for n in names})
        parts = {}
        for name, rows in made.items():
            folder = f"{name}/{uuid.uuid4().hex}"
            store.conform(rows, name).write.parquet(f"{path}/{folder}")
            parts[name] = [{"folder": folder, "base": None}]
        return versions.commit(spark, path, old, {"tables": {**old["tables"], **parts}, "next": old["next"]})

    return versions.retried(once)


def delete(spark: SparkSession, path: str, table: str, gone: DataFrame) -> dict:
    """Delete rows (id) of a table with all that hangs on them."""
    return change(spark, path, list(store.TABLES), lambda tables: store.without(tables, table, gone))


def new_sessions(users: DataFrame, token: Column, now: Column) -> DataFrame:
    """Rows of ``sessions`` for users (id): of the raw token only the digest is kept."""
    until = (now + F.lit(timedelta(hours=config.SESSION_HOURS))).cast("string")
    return users.select(F.col("id").alias("user_id"), F.sha2(token, 256).alias("token_hash"), now.cast("string").alias("created_at"), until.alias("expires_at"))


def without_session(sessions: DataFrame, token: str) -> DataFrame:
    return sessions.where(F.col("token_hash") != F.sha2(F.lit(token), 256))
