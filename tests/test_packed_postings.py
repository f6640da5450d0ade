"""Windows cut from bytes, and posting blocks that are one row for each folder and block of chunks."""

import random
import re

from pyspark.sql import functions as F

from claimloom.operators import chunking
from claimloom.sources import segments, versions


def test_windows_equal_a_plain_form_and_need_no_word_arrays(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "".join(rng.choices("ab é  \t\n\r\x0b\x0cx\x00\x1c", k=rng.randint(1, 60)))]), i % 3) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind int").coalesce(2)
    found = chunking.word_windows(docs, size=5, overlap=2, keep=("kind",))
    want = []
    for i, text, kind in rows:
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]
        starts = range(0, max(len(words) - 5 + 2, 0) + 1, 3) if words else ()
        want += [(i, no, f"{i}:{no}", " ".join(words[a : a + 5]), kind) for no, a in enumerate(starts)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "split(" not in found._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_a_folder_are_one_row(spark, tmp_path):
    path = str(tmp_path / "i")
    chunks = spark.createDataFrame([(f"c{i}", f"common own{i} a{i} b{i} c{i}") for i in range(200)], "chunk_id string, text string").coalesce(1)
    manifest = segments.build(chunks, path, block=50)
    rows = spark.read.parquet(f"{path}/postings")
    assert rows.where("bucket >= 0").count() <= 4 * manifest["buckets"]  # of 804 blocks
    assert segments.document_frequencies(spark, path).count() == 801


def test_deleted_terms_are_counted_down_without_texts(spark, tmp_path):
    path = str(tmp_path / "i")
    segments.build(spark.createDataFrame([(f"c{i}", f"common own{i}") for i in range(60)], "chunk_id string, text string"), path, block=8)
    texts = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/chunks")
    texts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(texts, True)
    segments.delete(spark.createDataFrame([("c3",), ("c59",)], "chunk_id string"), path)
    df = {r.term: r.df for r in segments.document_frequencies(spark, path).where(F.col("term").isin("common", "own3", "own4")).collect()}
    assert df == {"common": 58, "own4": 1} and versions.latest(spark, path)["segments"][-1]["n"] == -2
