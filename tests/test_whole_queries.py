from claimloom import queries as base


def test_history_holds_customers_of_all_nations(spark, tmp_path):
    for name, rows, schema in (
        ("customer", [(1, 2), (2, 3), (3, None)], "c_custkey long, c_nationkey long"),
        ("orders", [(1, 10), (2, 20), (3, 30)], "o_custkey long, o_orderkey long"),
        ("lineitem", [(10, 1, "A"), (20, 2, "R"), (20, 1, "N")], "l_orderkey long, l_linenumber int, l_returnflag string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert base.QUERIES["history_nested"] is base.QUERIES["history_nested_all"]
    got = {tuple(r) for r in base.QUERIES["history_nested_all"](spark, str(tmp_path)).collect()}
    assert got == {(1, 10, 1, "1:A"), (2, 20, 2, "1:N,2:R"), (3, 30, 0, "")}


def test_targets_count_tokens_of_the_whole_chunk(spark, tmp_path):
    filler = " ".join(f"filler{i}" for i in range(80))
    docs = [(1, f"{filler} quasar nebula"), (2, f"{filler} quasar nebula"), (3, "other words of no use here"), (4, "more other words of no use"), (5, "still other words of no use")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "quasar nebula")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("convergent_target", "convergent_target_all"):
        rows = base.QUERIES[name](spark, str(tmp_path)).collect()
        assert [(r.query_id, r.family, r.n, r.n_shared) for r in rows] == [(7, "s", 2, 2)]
