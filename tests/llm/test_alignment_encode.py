import gc

import numpy as np
import public_tokenizers

from lexicarta.llm import alignment


def test_encoding_is_not_stopped_for_collections():
    """The table of chunks grows with the texts; no collection walks it."""
    pair = alignment.TokenPair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["", None, "a b", " ".join(f"w{k} x{k * 7}" for k in range(20_000))]
    seen, note = [], lambda phase, info: seen.append(phase)
    gc.callbacks.append(note)
    try:
        out = pair.encode(texts)
    finally:
        during = len(seen)
        gc.callbacks.remove(note)
    assert during == 0 and gc.isenabled()
    assert out[0] is None and out[1] is None
    for text, (a, b) in zip(texts[2:], out[2:]):
        assert a.dtype == b.dtype == np.uint32
        assert a.tolist() == pair.a.encode(" " + text, add_special_tokens=False).ids and b.tolist() == pair.b.encode(text)
