import numpy as np
import pytest

from claimloom.llm import token_files
from claimloom.llm.token_files import EliasFano

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("n,step", [(1, 5), (255, 1), (256, 3), (257, 900), (5000, 40), (3000, 0)])
def test_select_directory(n, step):
    rng = np.random.default_rng(n)
    values = np.cumsum(rng.integers(0, 2 * step + 1, n))
    ef = EliasFano.encode(values)
    assert len(ef.samples) == -(-n // token_files.SAMPLE)
    for i in {0, n - 1, n // 2, *rng.integers(0, n, 20).tolist()}:
        assert ef.at(i) == values[i]
        assert (ef.values(i, min(700, n - i)) == values[i : i + 700]).all()
    _, again = token_files.unpack_block(token_files.pack_block(np.zeros(int(values[-1]), np.uint32), values))
    assert (again.values(0, n) == values).all()


def test_space_is_near_minimal():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1000, 20000))
    ef = EliasFano.encode(values)
    bits = 8 * (len(ef.low) + len(ef.high) + ef.samples.nbytes) / len(values)
    assert bits <= 2.2 + np.log2(values[-1] / len(values))


def test_files_equal_the_untouched_library(spark):
    import zlib

    from tokenizers import Tokenizer

    from claimloom.llm.shared import new_path

    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "x,y. z", "word " * 40000, " \n x", "a\nb", "  a\xa0 b", None, "", "Über größe, naïve; ok"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, texts[3])], "doc_id long, text string")
    out = new_path(spark, "t")
    token_files.write(docs, out, path, added=True)
    got = token_files.read(spark, out).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8]
    at = 0
    for r in got:
        ids = [*plain.encode("no id" if r.doc_id is None else texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
