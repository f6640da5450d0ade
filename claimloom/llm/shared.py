"""Shared storage and small helpers for operators of several steps."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, local use) is a folder of our own
    made, once for each application.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="claimloom-")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/claimloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system.

    Workers live on into the next stage; what they keep is missing there.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        with contextlib.suppress(OSError, AttributeError):  # other C libraries lack the call
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(run):
    """A partition function that calls ``release`` when its partition ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def held_out(mod: int, rest: int):
    """crc32(doc_id as text) mod ``mod`` == ``rest``; a null id counts as its empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod == rest
