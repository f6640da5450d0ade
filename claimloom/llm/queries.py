"""One registered query for each operator of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, filter_audit, imatch, langid, licenses, near_dup, periodic_runs, pii, quality, segmentation, substring_dedup, token_files, topk
from .shared import held_out, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(_table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op2_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.samples(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), added=True)
    return token_files.read(spark, path)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(3, 1)
    labels = _table(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.fit(docs.where(~held), labels))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = held_out(4, 2)
    model = langid.fit(docs.where(~held).select("lang", "text"))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_passages(_table(spark, sf_dir, "documents")).drop("kept_text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(_table(spark, sf_dir, "documents"), size=2, percent=80).drop("mark")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _looped(docs: DataFrame) -> DataFrame:
    """Documents with crc32(doc_id as text) divisible by 10 repeat a stretch of their words to the end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.when(h % 10 == 0, F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = docs.select("doc_id", "text", g.alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    split = split.withColumn("a", (F.col("g") % F.when(F.col("n") > 0, F.col("n"))).cast("int"))
    split = split.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    loops = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    looped = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), loops), " ")
    return split.select("doc_id", F.coalesce(looped, "text").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(_looped(_table(spark, sf_dir, "documents")), min_length=6, min_exponent=4)
    longer = lambda a, b: b.length * a.period > a.length * b.period
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(longer(a, b), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    return (
        found.withColumn("best", best)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            "best.*",
            F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
            F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
            F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
        )
    )


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return imatch.next_to_next(docs, imatch.lexicon(docs))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_segmentations": op2_segmentations,
    "op3_token_files": op3_token_files,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_licenses": op6_licenses,
    "op7_passages": op7_passages,
    "op8_decontamination": op8_decontamination,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_pii": op10_pii,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fingerprints": op12_fingerprints,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op8_decontamination": r"""
        WITH dw AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t-\r]+'), lambda w: w <> '') AS w FROM documents),
        iw AS (
            SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \t-\r]+'), lambda w: w <> '') AS w FROM benchmark),
        sizes AS (SELECT DISTINCT least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
        ds AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes)),
        it AS (
            SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM iw WHERE len(w) > 0)),
        n AS (SELECT item_id, count(*) AS n_item FROM it GROUP BY item_id),
        m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN it USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
        FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
    """,
    "op13_filter_audit": r"""
        WITH docs AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        failed AS (
            SELECT doc_id, part,
                   CAST(len(w) < 200 AS INTEGER)
                   + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
                   + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INTEGER)
                   + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
                   + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS mask
            FROM docs),
        marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
        m AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
            FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
        orders AS (
            SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
            FROM f a, f b, f c, f d, f e WHERE a.b | b.b | c.b | d.b | e.b = 31),
        steps AS (
            SELECT filter_order, step, bits[step] AS bit, coalesce(CAST(list_sum(bits[1:step - 1]) AS INTEGER), 0) AS before
            FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
        r AS (
            SELECT part, filter_order, step, bit,
                   coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
                   coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS removed,
                   coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant,
                   coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS good_lost,
                   coalesce(sum(bad) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost
            FROM steps, m GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM r
    """,
}
