"""Merge-type pieces against the public library."""

import hashlib
import random

import numpy as np
import pytest

from lectern.llm import piece_bpe
from lectern.llm.queries import piece_model

ODD = ["", " ", "  ", " a ", "a▁b▁▁ c", "\n\n  x\t", "<s> <unk> <0x0A>", "日本語 テスト 中文", "x" * 9000, "é" * 500, "▁" * 100, " " * 37, "ab" * 200 + "中" * 300, "\x00\x01", "😀👩‍👩‍👧", "　x y"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def codec():
    return piece_bpe.PieceCodec(piece_model())


def made_texts():
    rng = random.Random(1)
    texts = list(ODD)
    texts += ["".join(rng.choices("abcdefgh ▁  etaoinsr\nñé中日的😀0123.,", k=rng.randint(1, 200))) for _ in range(400)]
    texts += ["".join(chr(rng.randint(32, 0x2FFF)) for _ in range(rng.randint(1, 150))) for _ in range(100)]
    return texts + ["".join(rng.choices("etaoinsrhl", k=rng.randint(50, 400))) for _ in range(60)]


@pytest.mark.parametrize("short,kept", [(255, 300_000), (5, 300_000), (255, 10)])
def test_encodes_as_the_library(monkeypatch, library, codec, short, kept):
    monkeypatch.setattr(piece_bpe, "SHORT", short)
    monkeypatch.setattr(piece_bpe, "CACHE_WORDS", kept)
    codec.cache.clear()
    texts = made_texts()
    for text, ids, want in zip(texts, codec.encode(texts), library.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert codec.decode(ids).decode() == library.decode(want)


def test_decodes_any_ids(library, codec):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 28705, 0, 1, 2, 264]) for _ in range(rng.randint(0, 8))]
        assert codec.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids), ids


def test_backtracks(codec):
    """Some words need a shorter piece than the longest one, and some a step back."""
    words = [piece_bpe.BLANK + "".join(random.Random(i).choices("etaoinsrhlcd", k=14)) for i in range(2000)]
    letters = codec.letter[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
    ends = np.cumsum([len(w) for w in words])
    best = codec.longest(letters, ends - 15, ends)
    place, token = codec.walk(words)
    assert (best[place] != token).any()
    assert all(codec.fit(a, b) == f for a, b, f in zip(token[:-1].tolist(), token[1:].tolist(), codec.compatible(token[:-1], token[1:]).tolist()))


def test_round_trip_rows(spark, library):
    texts = [*made_texts()[:60], None, "same", "same"]
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in piece_bpe.round_trip(docs, piece_model()).collect()), key=key) == sorted(want, key=key)
    assert piece_bpe.round_trip(docs.where("false"), piece_model()).count() == 0
    there = piece_bpe.decode_documents(piece_bpe.encode_documents(docs, piece_model()), piece_model())
    assert all(r.decoded == library.decode(library.encode(r.text or "")) for r in there.collect())
