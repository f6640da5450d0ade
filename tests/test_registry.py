import duckdb
import pytest

import __spark_entry__ as registry
from claimloom import queries as base

DATA = "/root/testdata/sf0.001"
QUICK = ["normalize_text", "chunk_words_512", "bm25_topk", "claim_aggregate", "answer_blocks", "history_nested", "query_expansion"]


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_equal_to_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "customer", "orders", "lineitem", "embeddings", "labels", "events", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(base.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    got = sorted((tuple(r) for r in base.QUERIES[name](spark, DATA).select(*columns).collect()), key=repr)
    assert got == rows
