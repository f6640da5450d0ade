import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from claimloom.llm import queries, token_files

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("more", [[], [("END.", {}), ("new line", {}), ("<s>", {"lstrip": True, "rstrip": True}), ("word", {"single_word": True})]])
def test_added_tokens_as_the_library_finds_them(tmp_path, more):
    from tokenizers import AddedToken, Tokenizer

    plain = Tokenizer.from_file(BPE)
    plain.add_tokens([AddedToken(t, **how) for t, how in more])
    plain.save(path := f"{tmp_path}/t.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(3)
    parts = ["<|endoftext|>", " ", "  ", "\n", "a", "word", "END.", "END", ".", "new line", "<s>", "don't", "é", "|>", "<|", "\t"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", ""] + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(600)]
    ids, sizes = token_files.Encoder(path, added=True).encode(texts)
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends):
        assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_op3_finds_the_end_marker_in_a_text(spark, tmp_path):
    rows = [(1, "a <|endoftext|> b"), (2, "next")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first, second = queries.op3_token_files(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert (first.n_tokens, first.ids_crc32) == (5, zlib.crc32(np.array([64, 220, 50256, 275, 0], "<u4").tobytes()))
    assert second.start == 5
