import hashlib
import random
import re

import pytest

from claimloom.llm import langid, licenses, pii, quality

WORDS = {"en": "the of and that with house river stone".split(), "fr": "le la et dans maison rivière été où".split(), "de": "der die und nicht haus fluß stein über".split()}


def _corpus(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(5, 60))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_language_on_held_out_rows(spark):
    model = langid.fit(spark.createDataFrame([(x, t) for _, t, x in _corpus(1, 150)] + [(None, "zz"), ("en", None)], "lang string, text string"))
    assert model.langs == ["de", "en", "fr"]
    test = _corpus(2, 60)
    docs = spark.createDataFrame([*test, (100, None, "x"), (101, "", "x"), (102, "12 34 !!", "x")], "doc_id long, text string, score string")
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert sum(rows[i].lang_pred == x for i, _, x in test) >= 58
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (100, 101, 102))
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_counts_do_not_depend_on_pieces():
    text = "".join(random.Random(0).choices("abc déf", k=3 * langid._CHUNK // 2))
    at, n = langid.counts_of(text, 12)
    assert n.sum() == sum(len(text) - k + 1 for k in langid.NGRAMS)


def test_any_number_of_languages(spark, monkeypatch):
    rows = [(f"l{i:03d}", " ".join([chr(0x4E00 + i) * 3, chr(0x4E00 + i)] * 5)) for i in range(300)]
    train = spark.createDataFrame(rows, "lang string, text string")
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)] + [(999, "none of them")], "doc_id long, text string")
    many = langid.fit(train)
    assert len(many.langs) == 300 and len(many.blocks) == 5
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, many).collect()}
    assert sum(got[i][0] == lang for i, (lang, _) in enumerate(rows)) == 300
    monkeypatch.setattr(langid, "BLOCK_LANGS", 512)
    one = langid.fit(train)
    assert len(one.blocks) == 1
    for r in langid.predict(docs, one).collect():
        assert r.lang_pred == got[r.doc_id][0] and r.score == pytest.approx(got[r.doc_id][1], rel=1e-5)


def test_language_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    model = langid.fit(empty)
    docs = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
    assert langid.predict(docs, model).first().lang_pred == "und"
    assert langid.predict(docs.limit(0), model).count() == 0


def _texts(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good = rng.random() < 0.6
        words = rng.choices(WORDS["en"], k=rng.randint(20, 200))
        out.append((i, " ".join(words if good else [w + rng.choice(["###", "$$$"]) for w in words]), int(good)))
    return out


def test_quality_on_held_out_rows(spark):
    train = _texts(1, 200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in train] + [(None, 1), (3, None), (999, 0)], "doc_id long, label int")
    model = quality.fit(docs, labels)
    test = _texts(2, 80)
    frame = spark.createDataFrame([(i, t, "x") for i, t, _ in test] + [(200, None, ""), (201, "", ""), (202, "the river " * 60000, "")], "doc_id long, text string, score string")
    rows = {r.doc_id: r.score for r in quality.score(frame, model).collect()}
    assert sum((rows[i] >= 0.5) == bool(q) for i, _, q in test) >= 76
    assert all(0 <= p <= 1 for p in rows.values()) and rows[200] == rows[201]


def test_quality_sees_the_end_of_a_text(spark):
    import numpy as np

    net = quality.Network()
    s = quality.Scorer(net)
    a, b = b"a" * 5000, b"a" * 4990 + b"#$%&!?<>{}"
    p = s(np.frombuffer(a + b, np.uint8), np.array([0, 5000, 10000]))
    assert p[0] != p[1]
    single = [s(np.frombuffer(x, np.uint8), np.array([0, 5000]))[0] for x in (a, b)]
    assert np.allclose(p, single)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert [r.score for r in quality.score(docs, quality.fit(docs, none)).collect()] == [0.5, 0.5]
    one = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, label int"))
    assert one == 0.75


LICENSED = [
    (1, "Released UNDER the MIT-License. And again under the mit license!"),
    (2, "Licensed under the Apache License, Version 2.0; not CC BY."),
    (3, "CC BY-NC 4.0 cc by nc"),
    (4, None),
    (5, ""),
    (6, "Permission is hereby granted, free of charge, to any person obtaining a copy of this nice software and associated documentation files"),
    (7, "under the mit"),
    (8, "the mit license under"),
    (9, "x " * 3000 + "apache license version 2 " * 50),
    (1, "Released UNDER the MIT-License. And again under the mit license!"),
]


def test_licenses_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in LICENSED], "doc_id long, text string, labels string")
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(LICENSED)
    by = {r.doc_id: r for r in rows}
    for i, text in LICENSED:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, x) for p, x in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = by[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert by[6].labels == "mit" and by[6].base_labels == "" and 0.6 <= by[6].score <= 1  # one word put in
    assert by[7].labels == "" and by[4].score == 0
    assert licenses.scan(docs.limit(0)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and pii._luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_spans_against_plain_patterns():
    rng = random.Random(3)
    bits = ["1", "2", "0", ".", ".", "@", "a", "-", " ", "+", "(", "12", "255", "é", ".com", "4111 1111 1111 1111", "+49 30 1234567", "x@y.z"]
    for _ in range(8000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 25)))
        assert pii.base_spans(text) == _plain(text), text


@pytest.fixture(scope="module")
def selector():
    return pii.Selector()


def test_more_spans_and_redaction(spark, selector):
    texts = ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "password=b7db7aa4a5fcc78305 x", "plain words only, nothing 12 here", "mail a@b.org now", None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in pii.summary(docs, selector).collect()}
    assert rows[0].spans.startswith("secret:") and rows[1].spans.startswith("secret:")
    assert rows[2].spans == "" and rows[4].spans == "" and rows[5].n_email == 0
    assert rows[3].base_sha256 == hashlib.sha256(b"email:5:12").hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(docs, selector).collect()}
    assert clean[3] == "mail [EMAIL] now" and "24be" not in clean[0] and clean[4] is None and clean[2] == texts[2]
    assert pii.summary(docs.limit(0), selector).count() == 0
    assert len(pii.detect(docs, selector).first().spans) == 1


def test_overlapping_spans_are_redacted_once():
    assert pii.redact_text("ab1.2.3.4cd", [("ip", 2, 9, 1.0), ("card", 4, 10, 1.0)]) == "ab[IP]d"
