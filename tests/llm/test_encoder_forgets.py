"""What an encoder keeps between steps."""

import random

import numpy as np
import public_tokenizers

from trackloom.llm import tokens


def test_encoder_forgets_long_pieces(monkeypatch):
    """Texts that cannot be cut are encoded, but not kept; what stays has the same ids."""
    for which, cut in (("byte_bpe_50k.json", "lead"), ("word_bpe_49k.json", "space")):
        monkeypatch.setattr(tokens, "REMEMBERED", 1_000)
        encode = tokens.Encoder(public_tokenizers.path(which), cut)
        rng = random.Random(3)
        for _ in range(4):
            texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.choice([1, 2, 5, 90]))) for _ in range(rng.randint(0, 60))) + rng.choice(["", "  odd -- text \u2019", "|", "\n", "\n\n", "a\tb"]) for _ in range(40)]
            ids, sizes = encode.encode(texts)
            want = [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
            assert ids.tolist() == [x for own in want for x in own] and sizes.tolist() == [len(own) for own in want]
            assert all(len(p) <= tokens.LONG for p in encode.numbers) and sorted(encode.numbers.values()) == list(range(len(encode.numbers)))
            n = len(encode.numbers)
            assert n <= 1_000 and encode.used == int(np.sum(encode.size[:n]))
