"""Versions of a folder: one manifest for each commit, and numbers that are given out once.

A commit creates the next manifest under a name that must not exist yet; of two
writers that started from the same version one succeeds and the other gets
``Conflict`` and may start again from the new version. Readers see whole
versions only, as a manifest names files that were written before it. The file
system must create a file without overwriting in one step, as HDFS does.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed in the meantime."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, at, _ = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file was made here; False if it exists already."""
    fs, at, jvm = _fs(spark, path)
    try:
        out = fs.create(at, False)
    except Exception as error:
        if "AlreadyExists" in str(error) or "already exists" in str(error):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def _load(spark: SparkSession, path: str) -> dict:
    fs, at, jvm = _fs(spark, path)
    for _ in range(50):
        stream = fs.open(at)
        try:
            text = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        if text.endswith("\n"):  # else its writer is still at it
            return json.loads(text)
        time.sleep(0.1)
    raise RuntimeError(f"{path} was never finished")


def latest(spark: SparkSession, path: str) -> dict | None:
    """The last committed manifest, with its ``version``."""
    found = _numbers(spark, f"{path}/_versions")
    return _load(spark, f"{path}/_versions/{found[-1]}.json") if found else None


def commit(spark: SparkSession, path: str, old: dict | None, new: dict) -> dict:
    """Make ``new`` the version after ``old`` or raise ``Conflict``."""
    number = old["version"] + 1 if old else 0
    full = {**new, "version": number}
    if not _create(spark, f"{path}/_versions/{number}.json", json.dumps(full) + "\n"):
        raise Conflict(f"version {number} of {path} exists already")
    return full


def claim_number(spark: SparkSession, folder: str) -> int:
    """A number that no other caller gets, also if it is never used."""
    number = (_numbers(spark, folder) or [-1])[-1] + 1
    while not _create(spark, f"{folder}/{number}", ""):
        number += 1
    return number


def retried(change: Callable[[], dict], times: int = 5) -> dict:
    """``change`` run again from the start each time that another writer came first."""
    for left in range(times - 1, -1, -1):
        try:
            return change()
        except Conflict:
            if not left:
                raise
    raise AssertionError
