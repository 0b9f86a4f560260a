"""Memory of one step of the encoder, which every executor holds once a core."""

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa

from trackloom.llm import tokens
from trackloom.llm.common import text_slices, texts_of


def test_a_step_of_encoding_stays_small():
    rng = random.Random(1)
    known = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(2_000)]
    batch = pa.record_batch({"text": [" ".join(rng.choices(known, k=400)) for _ in range(1_700)]})  # some 4 MB in one batch
    encode = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), "lead")
    encode.encode([" ".join(known)])
    tracemalloc.start()
    try:
        for own in text_slices(iter([batch]), "text", tokens.STEP_BYTES):
            encode.encode(texts_of(own))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 48 << 20, peak
