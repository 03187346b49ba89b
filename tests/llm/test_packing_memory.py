"""A worker of the packing step holds little beside its batch, since all cores of an executor have one."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from freightlake.llm import packing
from freightlake.llm.common import Words, give_back, steps


def test_encoding_needs_little_memory():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5_000, 330)) for _ in range(1_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1_000)), "text": pa.array(texts)})
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    give_back()
    tracemalloc.start()
    n = sum(len(encoder.encode(Words(data, offsets))[1]) for _, data, offsets in steps(iter([batch]), step_bytes=packing.ENCODE_BYTES))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 330_000 and peak < 60 << 20, peak


def test_words_that_come_again_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 400)
    encoder, calls = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words, hashes: (calls.extend(words), learn(words, hashes)))
    for k in range(20):  # 50 words of every text, and 100 of its own
        text = " ".join([f"w{i}," for i in range(50)] + [f"own{k}x{i}" for i in range(100)])
        ids, counts = encoder.encode(Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])))
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids and counts.sum() == len(ids)
    assert len(calls) == 50 + 20 * 100 and len(encoder.known) <= 400
