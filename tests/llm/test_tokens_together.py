"""Words of many texts are encoded together."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from speechmart.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def coder_of(room: int = packing.CACHE_ROOM) -> packing.WordCachedTokenizer:
    with open(VOCABULARY, encoding="utf-8") as f:
        return packing.WordCachedTokenizer(f.read(), cache_room=room)


def test_texts_together_equal_the_library(monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 3000)
    monkeypatch.setattr(packing, "LAID", 64)
    library, rng = Tokenizer.from_file(VOCABULARY), random.Random(4)
    bits = [*"ab's.,!|é1²ªž中 \n", " ", "\t", "\r", "\x85", " ", "\x1c", "́", "Ж", "҂", "Ġ", "Ċ", " été.", "\nUnd", " don't", "\nx.\ny,", "<|endoftext|>"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(6000)] + ["", "\n", " ", "a", "a\nb", "a.\nb"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for room in (packing.CACHE_ROOM, 5000, 0):
        coder = coder_of(room)
        for _ in range(2):  # the second time, words are remembered
            got = [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode_all(texts)]
            assert [t for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


def test_a_word_of_many_texts_is_asked_once(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=9)) for _ in range(400)]
    texts = ["First " + " ".join(w + rng.choice(["", ".", ",", ".\n" + rng.choice(words)]) for w in rng.choices(words, k=300)) for _ in range(300)]
    coder, asked = coder_of(0), []
    plain = coder._encode
    monkeypatch.setattr(coder, "_encode", lambda some: asked.extend(some) or plain(some))
    got = [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode_all(texts)]
    assert got == [e.ids for e in coder.library.encode_batch(texts, add_special_tokens=False)]
    # every word once behind a space and once behind a line's end, and every text's first word
    assert sum(map(len, asked)) < 2 * 10 * len(words) + 10 * len(texts)
