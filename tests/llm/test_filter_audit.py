import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from claimloom.llm import filter_audit
from claimloom.llm.queries import ORACLE_SQL, QUERIES


def test_table_of_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120) and len(set(filter_audit.ORDERS)) == 120
    for mask in range(32):
        for k, order in enumerate(filter_audit.ORDERS):
            assert table[mask, k] == next((i for i, c in enumerate(order) if mask >> "ABCDE".index(c) & 1), 5)


def test_masks_at_the_thresholds():
    words = [f"w{i}" for i in range(100)]
    texts = ["", " \n", " ".join(words * 2), " ".join(words * 2 + ["w0"]), " ".join(words * 2)[:-1], "a" * 97 + "ABC", "a" * 96 + "ABCD", "é" * 97 + "ABC", "x|y", "É" * 50]
    want = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        want.append((len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + 8 * bool(re.search(r"[#$%&*|]", t)))
    assert filter_audit.text_masks(pa.array(texts)).tolist() == want
    assert set(want) >= {0, 2, 5, 9}


def _brute(rows, labels):
    good, bad = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, x in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]], strict=True) if x}
        docs.append((lang or "", fails, i in good, i in bad))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = here
            for step, c in enumerate(order, 1):
                gone = [d for d in left if c in d[1]]
                left = [d for d in left if c not in d[1]]
                shapley[part, c] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(c in d[1] for d in here) - len(gone), sum(d[1] == {c} for d in here), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def _rows(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(120):
        n = int(rng.choice([0, 3, 150, 205, 400]))
        vocabulary = int(rng.choice([40, 500]))
        words = [str(rng.choice(["w", "W", "é", "#"], p=[0.96, 0.02, 0.015, 0.005])) + str(rng.integers(vocabulary)) for _ in range(n)]
        rows.append((i, " ".join(words), [None, "en", "fr", ""][int(rng.integers(4))]))
    rows += [(i, rows[7][1], "en") for i in range(200, 240)] + [(None, rows[7][1], "en"), (None, None, None), (300, None, "de"), (7, rows[7][1], "fr")]
    return rows, [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 240, 3)] + [(3, 1, 1), (None, 1, 1)]


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    rows, labels = _rows(3)
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = _brute(rows, labels)
    got = QUERIES["op13_filter_audit"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(con.execute(ORACLE_SQL["op13_filter_audit"]).fetchall()) == want


def test_many_parts_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 2)
    rows, labels = _rows(4)
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, part string, mask int, n int")
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, good string")
    assert sorted(map(tuple, filter_audit.audit(docs, marks).collect())) == _brute(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_held_sums_leave_when_there_are_many_parts(monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 2)
    held, out = filter_audit.Held(), []
    for part in "abacabb":
        out += held.add(part, np.array([1, 2]), np.array([3]))
    out += held.rest()
    total = Counter()
    for batch in out:
        assert batch.num_rows <= 2
        for row in batch.to_pylist():
            assert row["removed"] == [row["seen"][0] // 3, 2 * row["seen"][0] // 3]
            total[row["part"]] += row["removed"][0]
    assert total == {"a": 3, "b": 3, "c": 1}
