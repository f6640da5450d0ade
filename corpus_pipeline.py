"""The corpus pipeline: five stages from raw documents to sampled segmentations.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. ``run`` writes what
a stage returns as Parquet to the shared folder and hands it, read again, to
the next one. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import decontamination, langid, near_dup, pii, segmentation
from claimloom.llm.shared import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told; the others have no letter.

    A posterior of 0 marks the others, as a corpus may have a language of the
    name ``UNKNOWN``. Where no row has a language all texts with a letter stay.
    """
    model = langid.fit(docs.select("lang", "text"))
    if not model.langs:
        return langid.with_letter(docs)
    told = langid.predict(docs, model, names=("predicted language", "its posterior"))
    return told.where(F.col("its posterior") > 0).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the least id."""
    gone = near_dup.groups(docs, size=5, percent=80).where(~F.col("kept")).select("doc_id", "mark").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.mark"))
    return docs.alias("d").join(gone.alias("g"), same, "left_anti")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.without_leaks(docs, items).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact personal data; ``n_chars`` follows the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document that is left."""
    return segmentation.samples(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", leaks),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", segmentations),
]

#: Learned models decide in several stages, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for no, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{no}")
    return docs


QUERIES = {"pipeline": run}
