"""Registered queries and, for each that SQL can express, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import spread

#: Tables whose rows cost much more to work on than to move.
TEXTS = ("documents", "conversations", "pages")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function under its name, or under another one."""

    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in TEXTS else found


from . import answering, contexts, drafting, evidence, guarding, ingestion, planned, prompting, searching, store, verification  # noqa: E402, F401
