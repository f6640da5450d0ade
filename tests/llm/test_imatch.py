import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from claimloom.llm import imatch
from claimloom.llm.queries import QUERIES

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _texts(seed, n, vocabulary=4000, longest=200):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéfg", k=6)) for _ in range(vocabulary)]
    return [" ".join(rng.choices(words, k=rng.randint(20, longest))) for _ in range(n)]


def test_band_leaves_out_rare_and_common_terms(spark, monkeypatch):
    rows = [(i, f"all only{i} pair{i // 2} ALL\tpair{i // 2}") for i in range(60)] + [(99, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    df = {r.term: r.df for r in imatch.frequencies(docs).collect()}
    assert sorted(df.values()) == [1] * 60 + [2] * 30 + [60]
    assert len(imatch.lexicon(docs).value) == 30
    monkeypatch.setattr(imatch, "MAX_TERMS", 20)
    assert len(imatch.lexicon(docs).value) == 0  # 180 pairs, so a term must stand in 9 documents
    assert len(imatch.lexicon(docs.limit(0)).value) == 0


def test_parts_by_sets(monkeypatch):
    texts = _texts(1, 30, 60)
    doc, term = imatch._pairs(pa.array(texts))
    sets = [set(term[doc == i].tolist()) for i in range(len(texts))]
    band = np.sort(np.array(sorted(set(term.tolist()))[::2], np.uint64))
    got = imatch.parts(pa.array(texts), band)
    chosen = [s & set(band.tolist()) for s in sets]
    for k, seed in enumerate(imatch._SEEDS.tolist()):
        ladder = [(m << e) for e in range(62) for m in range(5, 9)]
        for i, terms in enumerate(chosen):
            place = {t: t * seed % 2**64 for t in terms}
            point = min(x for x in ladder if x > min(place.values()))
            subset = [t for t in terms if place[t] < point]
            total = sum(int(imatch.mix(np.array([t], np.uint64) ^ np.uint64(0x51F7))[0]) for t in subset) % 2**64
            assert got[i, k] == int(imatch.mix(np.array([total ^ seed], np.uint64))[0]) >> 48


def _brute(rows, lexicon):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    fp = lambda t: imatch.parts(pa.array([t]), lexicon)[0]
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        cut = len(t) // 4
        e = t[: len(t) - cut] + after[:cut]
        a, b, c = fp(t), fp(e), fp(after)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a.astype(">u2").tobytes().hex(), b.astype(">u2").tobytes().hex(), float((a == b).mean()), float((a == c).mean())))
    return out


def _key(r):
    return tuple("" if x is None else str(x) for x in r)


@pytest.mark.parametrize("step", [imatch.STEP_BYTES, 700])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, step):
    monkeypatch.setattr(imatch, "STEP_BYTES", step)
    texts = _texts(2, 80)
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(1, texts[4]), (2, texts[4]), (4, None), (5, ""), (7, "é"), (8, "one two"), (None, "x y z " * 400)]
    random.Random(0).shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lexicon = imatch.lexicon(docs).value
    assert len(lexicon)
    got = QUERIES["op12_fingerprints"](spark, str(tmp_path))
    assert got.columns == COLUMNS
    got = [tuple(r) for r in got.collect()]
    assert sorted(got, key=_key) == sorted(_brute(rows, lexicon), key=_key)
    by_id = {r[0]: r for r in got}
    assert by_id[1][3] == by_id[2][3] == by_id[12][3] and by_id[1][6] == 1.0
    assert by_id[4][3] == by_id[5][3] != by_id[7][3] and by_id[4][6] == 1.0
    assert len({r[3] for r in got}) == len({t or "" for _, t in rows})


def test_edited_texts_are_nearer_than_others(spark):
    docs = spark.createDataFrame(list(enumerate(_texts(3, 200, 3000, 400))), "doc_id long, text string")
    rows = imatch.next_to_next(docs, imatch.lexicon(docs)).collect()
    assert np.mean([r.near_edited for r in rows]) > 0.5
    assert np.mean([r.near_next for r in rows]) < 0.1


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 1)], "doc_id long, text string, fingerprint string, task int")
    lexicon = imatch.lexicon(docs)
    rows = imatch.next_to_next(docs, lexicon).collect()
    assert [(r.doc_id, r.n_chars, r.near_edited, r.near_next) for r in rows] == [(1, 3, 1.0, 1.0)] * 2
    one = imatch.next_to_next(docs.limit(1), lexicon).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert imatch.next_to_next(docs.limit(0), lexicon).count() == 0
    assert [r.fingerprint for r in imatch.fingerprints(docs, lexicon).collect()] == [r.fingerprint for r in rows]
    strings = spark.createDataFrame([("b", "p q r s"), ("a", "t u v w")], "doc_id string, text string")
    assert {r.doc_id: r.n_chars for r in imatch.next_to_next(strings, lexicon).collect()} == {"a": 7, "b": 7}
