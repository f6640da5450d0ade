import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _kept(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)
    out = pipeline.language(spark, docs, "")
    assert out.dtypes == docs.dtypes
    return {r.doc_id for r in out.collect()}


def test_language_stage_without_labels_keeps_texts_with_letters(spark):
    assert _kept(spark, [(1, "clean words here", None), (2, "日本", None), (3, "12 !!", None), (4, "", None), (5, None, None)]) == {1, 2}


def test_language_stage_knows_a_language_named_und(spark):
    assert _kept(spark, [(1, "clean words here", "und"), (2, "more of these words", "und"), (3, "12 !!", "und"), (4, None, "und")]) == {1, 2}
