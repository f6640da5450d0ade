"""License scan by diagonal voting.

Every rolling hash of ``K`` words of a document is looked up among the hashes
of the templates; hits join the template positions, and each hit votes for the
diagonal (document position minus template position). Votes are counted by
diagonal, diagonals up to ``DRIFT`` words apart (words put in or left out) are
merged, and a span counts if the words it shares with the template, compared as
words and not as hashes, cover enough of the template.

Rows that hit no template hash carry no vote, so they are dropped where they
are read: the set of template hashes is fixed by the templates and small.
Short phrases are wanted word for word; a phrase stands where a diagonal has
all of its votes.

Defined cases: a null text is an empty one (no word, no label, score 0); each
row of the input gives one row, also for repeated ids and texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize
from .wordhash import ALNUM_OR_HIGH, Rolling, by_bytes, split_words

K = 3
DRIFT = 3
#: Least share of a template's words that a span must have.
COVERAGE = 0.6

#: Phrases that are wanted word for word.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Longer passages, of which a span may miss some words.
PASSAGES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "the software is provided as is without warranty of any kind express or implied": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2",
    "this work is licensed under a creative commons attribution noncommercial international license": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2",
}

_GRAMS = Rolling(0x11CE)


def _template_rows() -> list[tuple]:
    rows = []
    for no, (text, label) in enumerate([*PHRASES.items(), *PASSAGES.items()]):
        words = text.split()
        w = split_words(pa.array([text]), inside=ALNUM_OR_HIGH)
        prefix = _GRAMS.prefix(w.hashes)
        at = np.arange(len(words) - K + 1)
        for i, h in zip(at.tolist(), _GRAMS.slices(prefix, at, at + K).view(np.int64).tolist(), strict=True):
            rows.append((h, no, i, " ".join(words[i : i + K]), label, len(words), text in PHRASES))
    return rows


_TEMPLATE = "gram long, template int, t_pos int, t_words string, label string, t_len int, exact boolean"


def scan(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): word count, base places, labels and score."""
    spark = docs.sparkSession
    templates = _template_rows()
    known = np.unique(np.array([r[0] for r in templates], np.int64))
    low = np.zeros(1 << 16, bool)
    low[known & 0xFFFF] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = pa.list_(pa.struct([("pos", pa.int64()), ("gram", pa.int64()), ("words", pa.string())]))
        for whole in batches:
            for batch in by_bytes(whole, "text", 2_000_000):
                w = split_words(batch.column(1), lower=True, inside=ALNUM_OR_HIGH)
                counts = np.diff(w.first)
                found: list[list] = [[] for _ in range(batch.num_rows)]
                if len(w.hashes) >= K:
                    at = np.arange(len(w.hashes) - K + 1)
                    grams = _GRAMS.slices(_GRAMS.prefix(w.hashes), at, at + K).view(np.int64)
                    at = at[low[grams & 0xFFFF]]
                    place = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
                    at = at[known[place] == grams[at]]
                    doc = np.searchsorted(w.first, at, side="right") - 1
                    inside = at + K <= w.first[doc + 1]
                    for p, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
                        found[d].append({"pos": p - int(w.first[d]), "gram": int(grams[p]), "words": b" ".join(w.text(p + i) for i in range(K)).decode("utf-8", "replace")})
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), pa.array(found, hit)], names=["doc_id", "n_words", "hits"])

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_words long, hits array<struct<pos: long, gram: long, words: string>>").fields])
    rows = docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "license-hits")

    hits = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    # the templates are constants of this module
    votes = hits.join(F.broadcast(spark.createDataFrame(templates, _TEMPLATE)), "gram").where(F.col("words") == F.col("t_words"))
    by_diagonal = votes.groupBy("row", "template", "label", "t_len", "exact", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_pos").alias("seen"), F.min("pos").alias("from"), F.max("pos").alias("to")
    )
    order = W.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.coalesce(
        F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT) | (F.col("from") > F.lag("to").over(order) + F.col("t_len")), F.lit(True)
    )
    spans = (
        by_diagonal.withColumn("fresh", fresh.cast("int"))
        .withColumn("span", F.sum("fresh").over(order))
        .groupBy("row", "template", "label", "t_len", "exact", "span")
        .agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("diagonal").alias("place"))
    )
    words = F.size(F.array_distinct(F.flatten(F.transform("seen", lambda p: F.sequence(p, p + F.lit(K - 1))))))
    judged = spans.withColumn("cover", words / F.col("t_len")).where(F.when(F.col("exact"), F.col("cover") == 1).otherwise(F.col("cover") >= COVERAGE))
    base = F.col("exact")
    per_row = judged.groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("place"))).alias("first_word"),
        F.max(F.when(base, F.col("place"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    return (
        rows.select("row", "doc_id", "n_words")
        .join(per_row, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
            F.col("first_word").cast("long").alias("first_word"),
            F.col("last_word").cast("long").alias("last_word"),
            F.coalesce("base_labels", F.lit("")).alias("base_labels"),
            F.coalesce("labels", F.lit("")).alias("labels"),
            F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
        )
    )
