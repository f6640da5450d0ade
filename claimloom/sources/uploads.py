"""Uploaded files: checks, decoding, documents, and the index of each user."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking

# Suffixes, limits, and the order in which encodings are tried.
SUFFIXES = [".docx", ".md", ".pdf", ".txt"]
MAX_BYTES = 25 * 1024 * 1024
MAX_FILES = 10
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
NO_INDEX = "unavailable:no_user_upload_index"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def suffix(name) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(tx._c(name), F.lit("")), r"[^/\\.](\.[^./\\]+)$", 1))


def rejection(name, n_bytes) -> Column:
    """Why a file is not taken, or null."""
    said, size = F.coalesce(tx._c(name), F.lit("")), F.coalesce(tx._c(n_bytes), F.lit(0))
    own = F.when(suffix(name) == "", "<none>").otherwise(suffix(name))
    return (
        F.when(said == "", "Uploaded files must have a filename.").when(~suffix(name).isin(SUFFIXES), F.concat(F.lit("Unsupported file type '"), own, F.lit(f"'. Allowed: {', '.join(SUFFIXES)}.")))
        .when(size == 0, F.concat(F.lit("Uploaded file '"), said, F.lit("' is empty."))).when(size > MAX_BYTES, F.concat(F.lit("Uploaded file '"), said, F.lit(f"' exceeds the {MAX_BYTES} byte limit.")))
    )


def decoded(data: bytes) -> str:
    """Text of bytes in the first encoding that fits; the last one always does."""
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    raise ValueError("no encoding fits")


def docx_text(data: bytes) -> str:
    """The paragraphs of a word-processor file that are not blank, with an empty line between them."""
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        root = ElementTree.fromstring(parts.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")).strip() for p in root.iter(f"{_WORD}p"))
    return "\n\n".join(x for x in lines if x)


def texts(files: DataFrame) -> DataFrame:
    """``files`` (name, content) with text and error; PDF files come in as blocks, see ``pages``."""

    def read(name: str, data: bytes) -> tuple[str | None, str | None]:
        try:
            text = docx_text(data) if name.lower().endswith(".docx") else decoded(data).strip()
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None, f"Failed to parse DOCX file '{name}'."
        return (text, None) if text else (None, f"Uploaded file '{name}' did not contain readable text.")

    @F.pandas_udf("text string, error string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names_, contents in parts:
            yield pd.DataFrame([read(n or "", bytes(c or b"")) for n, c in zip(names_, contents, strict=True)], columns=["text", "error"])

    return files.withColumn("read_", run("name", "content")).select("*", "read_.text", "read_.error").drop("read_")


def taken(files: DataFrame, *, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) of the files (by, name, content, is_privileged) of uploads.

    Of an upload at most ten files are taken; files beyond, unreadable or refused
    ones stand in the second table with their reason.
    """
    from pyspark.sql import Window as W

    sized = files.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("name")))
    why = F.coalesce(rejection("name", F.octet_length("content")), F.when(F.col("place") > MAX_FILES, f"At most {MAX_FILES} files can be uploaded."))
    checked = sized.withColumn("reason", why)
    read = texts(checked.where("reason is null"))
    title = tx.strip(F.translate(F.regexp_replace("name", r"\.[^.]*$", ""), "_-", "  "))
    documents = read.where("error is null").select(
        *by, tx.upload_id("name", "text").alias("id"), F.lit("user_upload").alias("doc_type"), F.col("text").alias("full_text"), F.when(title == "", F.col("name")).otherwise(title).alias("case_name"),
        F.col("name").alias("source_file"), F.coalesce("is_privileged", F.lit(False)).alias("is_privileged"), F.current_timestamp().alias("uploaded_at"),
    )
    refused = checked.where("reason is not null").select(*by, "name", "reason").unionByName(read.where("error is not null").select(*by, "name", F.col("error").alias("reason")))
    return documents, refused


def write_index(documents: DataFrame, path: str, *, user: str = "user_id") -> None:
    """Chunks of every user's documents under ``path``, in a folder for each user, which replace those of the same user."""
    pieces = chunking.word_windows(documents.select(user, F.struct(user, "id").alias("k"), F.col("full_text").alias("text")).select("k", "text").withColumn("k", F.to_json("k")), key="k")
    parsed = F.from_json("k", f"{user} string, id string")
    rows = pieces.select(parsed[user].alias(user), parsed["id"].alias("doc_id"), "chunk_index", F.concat(parsed["id"], F.lit(":"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text")
    rows.write.partitionBy(user).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def user_chunks(spark: SparkSession, path: str, user_id: str, *, user: str = "user_id") -> tuple[DataFrame | None, str]:
    """The chunks of one user, read from its folder alone, or that there is none."""
    try:
        own = spark.read.schema("doc_id string, chunk_index long, chunk_id string, text string, " + f"{user} string").parquet(path).where(F.col(user) == user_id)
        return (None, NO_INDEX) if own.isEmpty() else (own, "ok")
    except Exception as error:  # noqa: BLE001 - a folder that isn't there fails in ways that depend on the store
        if "PATH_NOT_FOUND" in str(error):
            return None, NO_INDEX
        return None, f"error:{type(error).__name__}"
