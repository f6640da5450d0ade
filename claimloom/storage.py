"""Steps that are used more than once, written to the folder all executors share."""

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

_OWN: dict[str, str] = {}
#: Rows whose texts are Python objects at a time.
PIECE_ROWS = 128


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset (tests, local use) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="claimloom-")
    return _OWN[app]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/claimloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The table, written once and read back: later steps don't compute it again."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt to all cores: a small file is one task however its text is used."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def pieces(batches, rows: int = PIECE_ROWS):
    """The batches in slices of few rows: what Python makes of texts is several times as large as they are."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def releasing(run):
    """A partition function that gives a worker's unused memory back when its partition ends: workers live on."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform.startswith("linux"):
                with contextlib.suppress(OSError, AttributeError):  # other C libraries lack the call
                    ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped
