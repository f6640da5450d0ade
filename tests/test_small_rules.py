from pyspark.sql import functions as F

from claimloom.operators import answers, drafting
from claimloom.sources import pages


def _one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{c} {'int' if isinstance(v, int) else 'string'}" for c, v in values.items()))
    return df.select(column).first()[0]


def test_synopsis_keeps_telling_lines(spark):
    text = "SUPREME COURT OF THE STATE\nplain line\n | Case No. 12-34 | \r\nsee 410 U.S. 113 there\nDecided May 3, 1999\nnothing"
    assert _one(spark, pages.synopsis("t"), t=text) == "SUPREME COURT OF THE STATE\nCase No. 12-34\nsee 410 U.S. 113 there\nDecided May 3, 1999"
    assert _one(spark, pages.synopsis("t", 30), t=text) == "SUPREME COURT OF THE STATE\nCas"
    assert _one(spark, pages.synopsis("t", 9), t="plain   words  alone") == "plain w"
    assert spark.range(1).select(pages.synopsis(F.lit(None).cast("string"))).first()[0] == ""


def test_low_value_texts(spark):
    texts = {"Here is the answer to it all.": True, "Smith, 410 U.S.": True, "The witness was called Dr. ": True, "Short.": True, "There is insufficient support in retrieved authorities.": True, "The court held that the rule applies.": False, None: True}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", drafting.low_value("t").alias("v")).collect()
    assert {r.t: r.v for r in rows} == texts


def test_absence_answer_and_warning(spark):
    row = spark.createDataFrame([("applied:user_upload_absence", "What is the notice period in my memo?", "draft")], "s string, q string, d string")
    assert row.select(drafting.absence_answer(F.col("s"), "q", "d")).first()[0] == "The uploaded document excerpt does not identify a notice period in my memo."
    rows = spark.createDataFrame([(1, 4, 4, True), (2, 4, 3, True), (3, 4, 1, False)], "id int, total long, unsupported long, show_warning boolean")
    told = {r.id: r.warning for r in answers.warning(rows).collect()}
    assert told[1] == "This response is largely unsupported by retrieved evidence (4 of 4 claims unsupported)." and told[2].startswith("A large share") and told[3] is None


def test_cases_of_claims_and_interactions(spark):
    schema = "claim_id string, relationship string, doc_id string, chunk_id string, source_label string, score double"
    links = spark.createDataFrame([("c1", "supporting", "d1", "k1", "A", 0.5), ("c1", "supporting", "d2", "k2", "B", 0.9), ("c2", "mentions", "d3", "k3", "C", 1.0)], schema)
    best = spark.createDataFrame([("c1", "supporting", "d9", "k9", "Z", 1.0), ("c2", "contradicting", "D2", "k2", "b", None), ("c3", "supporting", "d2 ", "K2", "B", 0.95)], schema)
    cases = answers.cases_of_claims(links, best)
    assert {(r.claim_id, r.relation, r.doc_id, r.score) for r in cases.collect()} == {("c1", "support", "d2", 0.9), ("c2", "contradiction", "D2", None), ("c3", "support", "d2 ", 0.95)}
    claims = spark.createDataFrame([(7, "c1"), (7, "c2"), (7, "c3")], "interaction_id int, claim_id string")
    got = answers.cases_of_interactions(cases, claims, by="interaction_id").collect()
    assert {(r.relation, r.label, r.score) for r in got} == {("support", "B", 0.95), ("contradiction", "b", None)}
