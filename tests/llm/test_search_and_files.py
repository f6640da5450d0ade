import random
import zlib

import numpy as np
import pytest

from claimloom.llm import segmentation, token_files, topk
from claimloom.llm.shared import new_path

P = pytest.importorskip("public_tokenizers")
BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b \n c", "don't 's", "<|endoftext|>", "é😀 日本", "x" * 5000, "foo.bar, baz!!\n\n", "1 2  3", "\ttab", "a b"]


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def _brute(rows, k, scale=64):
    usable = {}
    for i, v, *_ in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.setdefault(i, []).append([int(np.floor(scale * np.float64(np.float32(x)))) for x in v])
    out = set()
    for q, vs in usable.items():
        if q % 20:
            continue
        a = min(vs)
        scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, bs in usable.items() if c != q for b in bs)[:k]
        out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_topk_is_exact(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], 0) for i in range(300)]
    rows += [(300, None, 0), (320, [0.1, None] * 4, 0), (340, [float("nan")] * 8, 0), (360, [float("inf")] * 8, 0), (380, [0.5] * 8, 0), (381, [0.5] * 8, 0), (382, [0.5] * 8, 0), (400, [0.2] * 3, 0)]
    df = _vectors(spark, rows)
    v = topk.integer_vectors(df)
    got = {tuple(r) for r in topk.search(v, v.where("vec_id % 20 = 0"), k=7).collect()}
    want = _brute([(i, (x + [0] * 8)[:8] if x and i == 400 else x) for i, x, _ in rows], 7)
    assert got == want


def test_topk_of_nothing(spark):
    v = topk.integer_vectors(_vectors(spark, []))
    assert topk.search(v, v).count() == 0


def test_maxscore_prunes_without_loss():
    rng = np.random.default_rng(0)
    x = rng.integers(-60, 60, (500, 16)) * (rng.random((500, 16)) < 0.2)
    q = rng.integers(-60, 60, (40, 16)) * (rng.random((40, 16)) < 0.3)
    full = q @ x.T
    threshold = np.sort(full, 1)[:, -10]
    row, col, score = topk.Shard(np.arange(500), x, int(np.abs(q).max())).search(q, threshold)
    assert {(r, c) for r, c in zip(row, col)} == set(zip(*np.nonzero(full >= threshold[:, None])))
    assert (score == full[row, col]).all()


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (5, 3), (1000, 50), (1000, 10**7)):
        values = np.sort(rng.integers(0, top + 1, n))
        ef = token_files.EliasFano.encode(values)
        assert (ef.select() == values).all()
        assert all(ef.at(i) == values[i] for i in range(0, n, max(1, n // 20)))
        if n:
            assert len(ef.low) + len(ef.high) <= n * (2 + max(0, np.log2(max(top, 1) / n))) / 8 + n / 8 + 8


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    plain.encode_special_tokens = True
    ids, sizes = token_files.Encoder(BPE).encode(ODD)
    ends = np.cumsum(sizes)
    for text, a, b in zip(ODD, ends - sizes, ends):
        assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    plain.encode_special_tokens = True
    rows = [(9 - i, t) for i, t in enumerate(ODD[:9])] + [(20, None), (21, "same"), (21, "same")]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, start string")
    path = new_path(spark, "t")
    token_files.write(docs, path, BPE)
    got = token_files.read(spark, path).orderBy("start").collect()
    at = 0
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_of_nothing(spark):
    path = new_path(spark, "t")
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), path, BPE)
    assert token_files.read(spark, path).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return segmentation.Pieces(PIECES)


def _all_segmentations(pieces, text):
    known = {pieces.text[i]: i for i in range(len(pieces.text)) if i not in pieces.byte_of and i > 2}
    unit = segmentation.SPACE + text.replace(" ", segmentation.SPACE)
    if not unit:
        return {}
    done = {len(unit): [((), 0.0)]}
    for at in range(len(unit) - 1, -1, -1):
        done[at] = [((known[unit[at:e]], *r), pieces.log_p[known[unit[at:e]]] + p) for e in range(at + 1, len(unit) + 1) if unit[at:e] in known for r, p in done[e]]
    total = np.logaddexp.reduce([p for _, p in done[0]])
    return {s: float(np.exp(p - total)) for s, p in done[0]}


def test_samples_follow_the_lattice(pieces):
    exact = _all_segmentations(pieces, "to be")
    n = 6000
    got = segmentation.sample_step(pieces, np.arange(n), ["to be"] * n, 2)
    first = {s: sum(tuple(g[0][0].tolist()) == s for g in got) / n for s in exact}
    second = {s: sum(tuple(g[1][0].tolist()) == s for g in got) / n for s in exact}
    for s, p in exact.items():
        assert abs(first[s] - p) < 0.03
        assert abs(second[s] - sum(q * p / (1 - q) for t, q in exact.items() if t != s)) < 0.03
    assert abs(np.mean([sum(np.exp(lp - li) for _, lp, _, li in g) for g in got]) - 1) < 0.1


def test_samples_are_distinct_seeded_and_decode(pieces):
    texts = ["the cat sat on the mat", *ODD]
    keys = np.arange(len(texts))
    a = segmentation.sample_step(pieces, keys, texts, 4)
    b = segmentation.sample_step(pieces, keys[::-1].copy(), texts[::-1], 4)[::-1]
    for text, x, y in zip(texts, a, b):
        ids = [s[0].tolist() for s in x]
        assert ids == [s[0].tolist() for s in y]
        assert len({tuple(i) for i in ids}) == len(ids)
        assert [s[2] for s in x] == sorted((s[2] for s in x), reverse=True)
        assert all(pieces.decode(i) == text for i in ids)
    assert len(a[1]) == 1 and a[1][0][3] == 0.0  # the empty text
    other = segmentation.sample_step(pieces, keys, texts, 4, seed=5)
    assert any(p[0][0].tolist() != q[0][0].tolist() for p, q in zip(a, other))


def test_few_segmentations_are_all_found(pieces):
    exact = _all_segmentations(pieces, "a")
    got = segmentation.sample_step(pieces, np.array([3]), ["a"], 50)[0]
    assert {tuple(s[0].tolist()) for s in got} == set(exact) and all(s[3] == 0.0 for s in got)


def test_segmentation_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (None, "c", "z")], "doc_id long, text string, sample string")
    rows = segmentation.samples(docs, PIECES).collect()
    assert all(r.decodes for r in rows) and len(rows) == 5
    decoded = segmentation.decode(segmentation.encode(docs, PIECES), PIECES)
    assert {(r.doc_id, r.text) for r in decoded.collect()} == {(1, "a b"), (2, ""), (None, "c")}
    assert segmentation.samples(docs.limit(0), PIECES).count() == 0
