"""The search for segmentations: what it leaves out, and its forms without arrays."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from claimloom.llm import segmentation

TEXTS = ["the cat sat on the mat " * 40, "a", "", "日本 " * 20, "x" * 300, "one\ntwo é 🎉 three ▁ four  five", " www.example.com/abc_123 " * 9]
#: Checksums of the ids drawn for TEXTS before NEAR came in.
GOLDEN = [[1991413049, 3910970328], [3845299652, 3342286259], [0], [2346734788], [593140657, 3182653949], [2100946166, 4247184709], [392575391, 4191723612]]


@pytest.fixture(scope="module")
def pieces():
    return segmentation.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def _plain(got):
    return [[(s[0].tolist(), *s[1:]) for s in g] for g in got]


def test_long_texts_need_few_gumbels(pieces, monkeypatch):
    drawn, of_arrays = [], segmentation._truncated
    monkeypatch.setattr(segmentation, "_truncated", lambda phi, *more: drawn.append(np.size(phi)) or of_arrays(phi, *more))
    text = "segmentation lattices undetermined " * 1000
    got = segmentation.sample_step(pieces, np.arange(3), [text] * 3, 2)
    assert all(len(g) == 2 and pieces.decode(s[0]) == text for g in got for s in g)
    assert min(len(s[0]) for g in got for s in g) > 6000 and sum(drawn) < 2000


@pytest.mark.parametrize("near", [0.0, 1.0, 20.0, 1e9])
@pytest.mark.parametrize("k", [1, 2, 7])
def test_what_is_left_out_changes_nothing(pieces, monkeypatch, near, k):
    keys = np.arange(len(TEXTS)) - 2
    usual = _plain(segmentation.sample_step(pieces, keys, TEXTS, k))
    monkeypatch.setattr(segmentation, "NEAR", near)
    assert _plain(segmentation.sample_step(pieces, keys, TEXTS, k)) == usual


def test_samples_are_those_of_the_whole_search(pieces):
    """Checksums of what the search without ``NEAR`` drew."""
    got = segmentation.sample_step(pieces, np.arange(len(TEXTS)), TEXTS, 2)
    assert [[zlib.crc32(s[0].astype("<u4").tobytes()) for s in g] for g in got] == GOLDEN


def test_forms_without_arrays(pieces):
    rng = np.random.default_rng(3)
    own = rng.integers(0, 1 << 64, 300, np.uint64)
    a, b, c = rng.integers(0, 5, 300), rng.choice([1 << 42, 1 << 45, 7], 300), rng.integers(0, 1 << 20, 300)
    u = segmentation._uniform(own, a, b, c)
    assert [segmentation._uniform_one(*x) for x in zip(own.tolist(), a.tolist(), b.tolist(), c.tolist())] == u.tolist()
    phi, bound = -rng.exponential(300, 300), rng.normal(0, 300, 300)
    expected = segmentation._truncated(phi, bound, -np.log(u))
    assert [segmentation._truncated_one(*x) for x in zip(phi.tolist(), bound.tolist(), u.tolist())] == pytest.approx(expected.tolist(), rel=1e-14)
    lattice = segmentation.Lattice(pieces)
    lattice.add(["▁segmentation", "▁the", "日é"])
    node = np.flatnonzero(~lattice.is_end)
    for u in rng.random((50, len(node))):
        assert [lattice.draw_one(n, x) for n, x in zip(node.tolist(), u.tolist())] == lattice.draw(node, u).tolist()
