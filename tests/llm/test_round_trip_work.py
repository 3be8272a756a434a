"""A round trip cuts each text once, sets off no search for cycles, and gives what encoding text by text does."""

import gc
import hashlib

import public_tokenizers
import pytest

from glyphmill.llm import bpe


def test_round_trip_does_no_work_twice(monkeypatch):
    codec = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    codec.memo.clear()
    texts = ["", " ", "a  b \n c ", "it's 12, déjà-vu; 語彙 " * 3, "x" * 200, *(" ".join(f"word{k}x{j}, {j}th" for j in range(60)) for k in range(100))]
    cut, searched = [], []
    monkeypatch.setattr(bpe.BpeCodec, "parts", lambda self, text, real=bpe.BpeCodec.parts: cut.append(text) or real(self, text))
    seen = lambda phase, _: phase == "start" and searched.append(1)
    gc.collect()
    gc.callbacks.append(seen)
    try:
        found = codec.round_trip(texts)
        during = len(searched)
    finally:
        gc.callbacks.remove(seen)
    assert cut == texts and not during and gc.isenabled()
    for text, got in zip(texts, found, strict=True):
        ids = codec.encode(text)
        assert got == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    with pytest.raises(TypeError):
        codec.round_trip([7])
    assert gc.isenabled()
