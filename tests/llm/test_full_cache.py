"""Encoding when the cache of words is full."""

import random

import numpy as np
import pytest

from lectern.llm import bpe
from lectern.llm.queries import vocabulary


@pytest.mark.parametrize("whole", [50, 1 << 20])
def test_full_cache(monkeypatch, whole):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    monkeypatch.setattr(bpe, "WHOLE_CHARS", whole)
    library, own = Tokenizer.from_file(vocabulary()), bpe.Codec(vocabulary())
    rng = random.Random(6)
    texts = ["the cat", *(" the".join(" " + "".join(rng.choices("abcde", k=4)) for _ in range(n)) for n in (3, 5, 8, 40, 5, 40))]
    for t in texts:  # each alone, so that some words are known from before
        (ids,) = own.encode([t]) if len(t) <= whole else [x for x in own.encode([t]) if x]
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
