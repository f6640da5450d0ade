"""Words of questions in other languages: boundaries are those of the SQL."""

import duckdb

from claimloom.operators import expansion
from claimloom.queries import ORACLES, QUERIES


def test_boundaries_inside_words_with_other_letters(spark, tmp_path):
    said = [(1, 0, "eine ätest sache hier"), (1, 1, "die ältestä sache hier"), (2, 1, "ein Fall wie éRoe v. Wade hier ß"), (2, 2, "was ß12 U.S. 34ü test dazu sagt")]
    spark.createDataFrame(said, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    expected = con.execute(ORACLES["query_expansion"]).fetchall()
    found = QUERIES["query_expansion"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert expansion.plans(spark.createDataFrame([("eine ätest sache hier",)], "query string"), mode="rule").first().status == "applied"
