import random

import numpy as np
import public_tokenizers

from claimloom.llm import pii, segmentation


def test_samples_are_equal_to_the_bit_for_any_batch():
    rng = random.Random(0)
    words = ["river", "stone", "Überfluß", "été", "xqzv", "internationalisation", "12345", "the"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 40]))) for _ in range(40)]
    keys = np.arange(40)
    pieces = segmentation.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    flat = lambda got: [[(ids.tolist(), *rest) for ids, *rest in of] for of in got]
    whole = flat(segmentation.sample_step(pieces, keys, texts, 4))
    alone = [flat(segmentation.sample_step(pieces, keys[i : i + 1], texts[i : i + 1], 4))[0] for i in range(40)]
    thirds = [x for at in range(0, 40, 13) for x in flat(segmentation.sample_step(pieces, keys[at : at + 13], texts[at : at + 13], 4))]
    assert whole == alone == thirds


def test_spans_are_taken_as_by_comparing_all_pairs():
    rng = random.Random(1)
    for _ in range(200):
        base = [(a, a + rng.randint(1, 6)) for a in rng.sample(range(60), 4)]
        taken, plain = pii.Taken(base), list(base)
        for _ in range(30):
            a = rng.randint(0, 60)
            b = a + rng.randint(1, 8)
            free = not any(a < d and c < b for c, d in plain)
            assert taken.put(a, b) == free
            if free:
                plain.append((a, b))
