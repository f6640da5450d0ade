import random

from claimloom import queries as base
from claimloom.operators import guards


def nearest(text, claim, start):
    if text[start : start + len(claim)] == claim:
        return start, start + len(claim)
    for hay, needle in ((text, claim), (text, claim.strip()), (text.lower(), claim.lower())):
        hits = [i for i in range(len(hay) - len(needle) + 1) if hay[i : i + len(needle)] == needle]
        if needle and hits:
            at = min(hits, key=lambda i: (abs(i - start), i))
            return at, at + len(needle)
    return None, None


def test_located_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        text = "".join(rng.choice("aAb é😀 ") for _ in range(rng.randint(0, 60)))
        claim = text[(at := rng.randint(0, 60)) : at + rng.randint(1, 4)] or rng.choice(["aa", "", " ab "])
        claim = rng.choice([claim, claim.upper(), f" {claim} ", "aba"])
        rows.append((i, text, claim, rng.randint(0, 70)))
    got = guards.located(spark.createDataFrame(rows, "id long, a string, c string, s long"), answer="a", claim="c", start="s").collect()
    assert {r["id"]: (r["start_at"], r["end_at"]) for r in got} == {i: nearest(a, c, s) for i, a, c, s in rows}


def test_claim_locations_look_past_400_characters(spark, tmp_path):
    piece = "Some words of notice"
    text = f"{'x' * 10}{piece}{'y' * 420}{piece.upper()}{'z' * 500}"
    spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["k"]: (r["start_at"], r["end_at"]) for r in base.QUERIES["claim_locations"](spark, str(tmp_path)).collect()}
    assert got == {0: (10, 30), 1: (450, 470), 2: nearest(text, f" {text[4:12]}  ", 0), 3: (None, None)}
