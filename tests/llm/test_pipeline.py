import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from claimloom.llm import pii, segmentation


def _documents():
    rng = random.Random(4)
    word = lambda: f"{rng.choice(['the', 'of', 'stone', 'river'])}{rng.choice(['', 'ing', 'ed', 's'])}{rng.choice('abcdefgh')}"
    rows = [(i, " ".join(word() for _ in range(rng.randint(20, 80)))) for i in range(20)]
    rows += [(30, rows[2][1]), (31, rows[3][1] + " tail"), (32, "12 34 56 !!"), (33, None), (34, ""), (35, "words of their own that no other text has, so write to me@mail.example or +49 30 1234567 now")]
    item = " ".join(word() for _ in range(30))
    rows += [(40, "lead words here " + item + " and more"), (41, " ".join(item.split()[:10])), (None, "no id but words of its own here")]
    return rows, item


def test_stages(spark, tmp_path):
    rows, item = _documents()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.5, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, mark string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, seen = docs, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        kept = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen[name] = kept
        if len(seen) < len(pipeline.STAGES):
            assert kept.dtypes == docs.dtypes
            assert kept.where("score <> 1.5 or mark <> 'x'").isEmpty()
    ids = [{r.doc_id for r in f.select("doc_id").distinct().collect()} for f in seen.values()]
    start = {i for i, _ in rows}
    assert ids[0] == start - {32, 33, 34}
    assert ids[1] == ids[0] - {30, 31}
    assert ids[2] == ids[1] - {40}
    assert ids[3] == ids[2] == ids[4]
    text = {r.doc_id: (r.text, r.n_chars) for r in list(seen.values())[3].collect()}
    assert text[35][0].endswith("write to [EMAIL] or [PHONE] now") and text[35][1] == len(text[35][0])
    assert all(text[i][0] == t for i, t in rows if i in text and i != 35)
    last = list(seen.values())[4]
    assert last.where("not decodes").isEmpty()
    assert last.groupBy("doc_id").agg(F.count_distinct("ids_crc32").alias("n")).where(f"n > {segmentation.SAMPLES}").isEmpty()
    assert not re.search("@", " ".join(t for t, _ in text.values())) and pii.base_spans(text[35][0]) == []


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
