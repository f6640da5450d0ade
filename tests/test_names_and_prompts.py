import pytest
from pyspark.sql import functions as F

from claimloom.functions import names
from claimloom.operators import posture, prompts


@pytest.mark.parametrize(
    ("name", "key"),
    [("J. P. Smith Co. v. U.S.", "jp smith v us"), ("Acme Corp. v. Jones", "acme v jones"), ("United States v. A B C Inc", "united states v abc"), ("", ""), (None, ""), ("Co. v. Inc.", "v")],
)
def test_case_keys(spark, name, key):
    assert spark.createDataFrame([(name,)], "n string").select(names.case_key("n").alias("k")).first().k == key


def test_families_and_matches(spark):
    r = spark.createDataFrame([("Brown v. Board Revisions: 2", "brown v board")], "a string, b string")
    got = r.select(names.family_key("a").alias("f"), names.names_match(names.case_key("a"), names.case_key("b")).alias("m"), names.names_match(names.case_key("a"), F.lit("")).alias("n")).first()
    assert (got.f, got.m, got.n) == ("brown v board", True, False)


def test_posture_lines(spark):
    rows = spark.createDataFrame([("X v. Y", "The petition for certiorari is denied. JUSTICE KAGAN, dissenting.")], "name string, text string")
    r = rows.select("name", *[v.alias(k) for k, v in posture.of_text(F.col("text")).items()])
    text = r.select(prompts.posture_lines("name").alias("p")).first().p
    assert "Decision type: cert denial" in text and "Opinion author: Kagan" in text and "do not describe the separate opinion" in text


def test_annotated_answers(spark):
    a = spark.createDataFrame([(1, "A < B. Yes."), (2, "plain & simple")], "id long, text string")
    b = spark.createDataFrame([(1, 7, 11, "supported", 1), (1, 0, 6, None, 0)], "id long, start long, end long, support_level string, claim_count long")
    got = {r.id: r.html for r in prompts.annotated(a, b, by="id").collect()}
    assert got == {1: 'A &lt; B. <span class="claim-supported">Yes.</span>', 2: "plain &amp; simple"}
