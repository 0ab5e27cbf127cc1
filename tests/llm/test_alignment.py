"""Alignment of two tokenizers against the public libraries and plain Python."""

import hashlib
import random
from collections import Counter

import pytest

from lectern.llm import alignment
from lectern.llm.queries import piece_model, vocabulary


def slow(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    letters = {}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for n, x in enumerate([*plain, *(x for x in range(256) if x not in plain)]):
        letters[chr(x) if n < len(plain) else chr(256 + n - len(plain))] = x
    found = []
    for i, text in rows:
        want = (" " + (text or "")).encode()
        x = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(t)) for t in x]
        bytes_b = [bytes([int(p[1:-1], 16)]) if b.is_byte(t) else p.replace("▁", " ").encode() for t, p in ((t, b.id_to_piece(t)) for t in y)]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            found.append((i, [], [], [], ""))
            continue
        spans = []
        for tokens in (bytes_a, bytes_b):
            at, own = 0, []
            for t in tokens:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [([t for t, (s, e) in zip(x, spans[0], strict=True) if low <= s and e <= high], [t for t, (s, e) in zip(y, spans[1], strict=True) if low <= s and e <= high]) for low, high in zip([0, *cuts], cuts)]
        links = [(t, u) for t, (s, e) in zip(x, spans[0], strict=True) for u, (v, w) in zip(y, spans[1], strict=True) if s < w and v < e]
        found.append((i, x, y, links, ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)))
    count = Counter(p for r in found for p in r[3])
    held = Counter(p for r in found for p in set(r[3]))
    top = {}
    for (_, u), n in count.items():
        top[u] = max(n, top.get(u, 0))
    rows = Counter((i, len(x), len(y), g.count(";") + 1 if g else 0, len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, x, y, links, g in found)
    return rows, {(*p, held[p], n, n == top[p[1]]) for p, n in count.items()}


def made_rows():
    rng = random.Random(3)
    odd = [None, "", " ", "  ", "\n", "a", " a", "a ", "a\n b", "a \n  b\t c", "x▁y", "<|endoftext|> <s> <0x41>", "it's  I'll\n\n  we 'd", "naïve café 日本語 😀", "\x00 \x1c b", "a b", "　x y", "a\x1c  b", "aaa " * 30, "1234567 3.14 a,b;c!!"]
    rows = [(n, t) for n, t in enumerate(odd)] + [(None, "a b c"), (7, " a"), (7, " a")]
    rows += [(100 + n, "".join(rng.choices("abcdet  \n▁é日'0123.,!", weights=[9] * 8 + [2, 0.01] + [2] * 10, k=rng.randint(1, 90)))) for n in range(150)]
    return rows + [(300 + n, " ".join("".join(rng.choices("etaoins", k=rng.randint(1, 12))) for _ in range(60))) for n in range(30)]


@pytest.mark.parametrize("small", [None, 40])
def test_alignment_against_plain_python(spark, small):
    rows = made_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_a string").repartition(3)
    want, pairs = slow(rows)
    got = alignment.aligned(docs, vocabulary(), piece_model(), **({} if small is None else {"block": small}))
    assert Counter(map(tuple, got.documents.collect())) == want
    assert {tuple(r) for r in got.pairs.collect()} == pairs
    none = alignment.aligned(docs.where("false"), vocabulary(), piece_model())
    assert none.documents.count() == none.pairs.count() == 0


def test_long_texts_and_a_full_cache(monkeypatch):
    rows = [r for r in made_rows() if r[1]]
    own = alignment.Aligner(vocabulary(), piece_model())
    first = [(*x[:4], x[4].tolist()) for x in own.documents([t for _, t in rows])]
    monkeypatch.setattr(alignment, "CACHE", 20)
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 10)
    monkeypatch.setattr(alignment, "LISTED", 3)
    own.cache.clear(), own.older.clear()
    assert first == [(*x[:4], x[4].tolist()) for x in own.documents([t for _, t in rows])]


def test_a_stretch_that_cannot_be_spelled_changes_no_other():
    own = alignment.Aligner(vocabulary(), piece_model())
    want = {s: (own.cache.clear(), own.older.clear(), own.learn({s}), own.cache[s])[3] for s in (" one", " two,three", " four\x1c", "  five")}
    for first in (" x▁y", " ▁", " a▁", " b\n"):
        own.cache.clear(), own.older.clear()
        own.learn({first, *want})
        assert {s: own.cache[s] for s in want} == want and (own.cache[first] == b"") == ("▁" in first)


def test_bitmaps_count_documents_and_links():
    import numpy as np

    rng = np.random.default_rng(4)
    times = {(int(p), int(d)): int(t) for p, d, t in zip(rng.integers(0, 40, 900), rng.integers(0, 3000, 900), rng.integers(1, 70, 900), strict=True)}
    keys = list(times)
    pair, words, ends, documents, links = alignment.bitmaps(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array(list(times.values())))
    for n, p in enumerate(pair.tolist()):
        own = words[ends[n - 1] if n else 0 : ends[n]]
        back = Counter()
        for w in own.tolist():
            for bit in range(16):
                if w[2] >> bit & 1:
                    back[w[1] * 16 + bit] += 1 << w[0]
        assert back == {d: t for (q, d), t in times.items() if q == p}
        assert documents[n] == len(back) and links[n] == sum(back.values())
