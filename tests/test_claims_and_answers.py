import pytest
from pyspark.sql import functions as F

from claimloom.operators import answers, claims, metrics, verification


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("The officer entered the residence and arrested Doe.", ["The officer entered the residence.", "The officer arrested Doe."]),
        ("This defect was not cured because the removal petition did not include the notice.", ["This defect was not cured.", "The removal petition did not include the notice."]),
        ("The rule is cited at 42 U.S.C. 1983 by Dr. Smith of Acme Inc. in D.C.", None),
        ("**Short Answer** The court denied the motion [2].", ["The court denied the motion."]),
    ],
)
def test_decomposition(text, expected):
    got = [c["text"] for c in claims.decompose("d", text)]
    if expected is None:
        assert len(got) == 1
    else:
        assert got == expected


def test_attribution():
    rows = claims.decompose("d", "Plaintiff alleges that Officer Smith entered the home without a warrant.")
    assert [r["text"] for r in rows] == ["Plaintiff alleges that Officer Smith entered the home without a warrant.", "Officer Smith entered the home without a warrant."]
    assert rows[1]["attributed"] == "alleged" and rows[0]["is_attribution"]


def test_ids_are_stable():
    a, b = claims.decompose("d", "One fact is here. Another fact is here."), claims.decompose("d", "One fact is here. Another fact is here.")
    assert [x["claim_id"] for x in a] == [x["claim_id"] for x in b] and len({x["claim_id"] for x in a}) == 2


@pytest.mark.parametrize(("score", "label"), [(0.71, "VERIFIED"), (0.55, "SUPPORTED"), (0.40, "POSSIBLE_SUPPORT"), (0.39, "UNSUPPORTED")])
def test_verdicts(spark, score, label):
    row = spark.createDataFrame([(score, False)], "s double, c boolean")
    assert row.select(verification.verdict("s", "c", F.lit(True)).alias("v")).first().v == label


def test_verdict_order(spark):
    rows = spark.createDataFrame([(0.9, True)], "s double, c boolean")
    assert rows.select(verification.verdict("s", "c", F.lit(True)).alias("v")).first().v == "CONTRADICTED"
    assert rows.select(verification.verdict("s", "c", F.lit(False)).alias("v")).first().v == "NO_EVIDENCE"


def test_pair_scorer():
    score = verification.PairScorer()
    assert score("The sky is blue today.", "the sky is blue") == (0.96, 0.03, 0.01)
    assert score("", "anything goes") == (0.05, 0.90, 0.05)
    e, _, c = score("The court granted the motion to dismiss the complaint.", "The court never granted the motion to dismiss the complaint.")
    assert c > 0.7 and e == 0.05


def _pairs(spark, rows):
    return spark.createDataFrame([(1, i, e, c, w, t, True, True) for i, e, c, w, t in rows], "claim_id long, idx long, e double, c double, w double, tier int, overlap_valid boolean, posture_valid boolean")


def test_aggregation(spark):
    r = verification.aggregate(_pairs(spark, [(0, 0.9, 0.03, 1.0, 5), (1, 0.1, 0.03, 0.4, 5)])).first()
    awe = (0.9 * 1.0 + 0.1 * 0.4 * 0.5) / (1.0 + 0.4 * 0.5)
    assert r.best_idx == 0 and not r.is_contradicted
    assert abs(r.final_score - (0.4 * 0.9 + 0.2 * 0.5 + 0.3 * awe)) < 1e-5


def test_contradiction(spark):
    r = verification.aggregate(_pairs(spark, [(0, 0.05, 0.93, 1.0, 5), (1, 0.3, 0.05, 1.0, 5)])).first()
    assert r.is_contradicted and r.contra_idx == 0


def test_score_grows_with_support(spark):
    scores = [verification.aggregate(_pairs(spark, [(0, e, 0.03, 1.0, 5)])).first().final_score for e in (0.1, 0.4, 0.6, 0.9)]
    assert scores == sorted(scores)


def test_spans_never_overlap_after_merging(spark):
    spans = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 3, 9), (1, "c", 9, 12), (1, "d", 20, 25), (1, "e", 21, 22)], "answer long, claim_id string, start long, end long")
    rows = answers.span_groups(spans, by="answer").groupBy("group_no").agg(F.min("start").alias("s"), F.max("end").alias("e")).orderBy("s").collect()
    assert [(r.s, r.e) for r in rows] == [(0, 9), (9, 12), (20, 25)]


def test_blocks(spark):
    text = "The court denied the motion. In short, that is it."
    a = spark.createDataFrame([(1, text)], "answer long, text string")
    s = spark.createDataFrame([(1, "c", 0, 28, "VERIFIED")], "answer long, claim_id string, start long, end long, verdict string")
    rows = answers.blocks(a, s, by="answer").orderBy("block_no").collect()
    assert [(r.type, text[r.start : r.end]) for r in rows] == [("verified_claim", "The court denied the motion."), ("transition", "In short, that is it.")]


def test_highlights(spark):
    rows = spark.createDataFrame([(1, 0, 10, 5), (1, 4, 8, 1), (1, 9, 12, 3)], "answer long, start long, end long, priority long")
    assert [(r.start, r.end) for r in answers.highlights(rows, by="answer").orderBy("start").collect()] == [(4, 8), (9, 12)]


def test_confusion(spark):
    rows = spark.createDataFrame([("m", True, True), ("m", False, True), ("m", True, False), ("m", False, False)], "mode string, actual boolean, predicted boolean")
    r = metrics.confusion(rows, by="mode").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.accuracy, r.f1) == (1, 1, 1, 1, 0.5, 0.5)
    empty = metrics.confusion(rows.where("actual and predicted and mode = 'm'").where("not actual or mode = 'x'"), by="mode")
    assert empty.count() == 0
