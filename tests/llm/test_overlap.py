"""Near copies of the pipeline's stage, against brute force."""

import random

import pytest

from lectern.llm import overlap

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    found = (text or "").lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def some(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def copies():
    """Texts and copies with words changed, ids mixed; similarity 0.5 to 0.99."""
    rng = random.Random(21)
    texts = []
    for n in range(120):
        first = some(rng, rng.randint(30, 400))
        texts.append(first)
        for changes in range(1, 5):
            copy = list(first)
            for at in rng.sample(range(len(copy)), max(1, changes * len(copy) // 180)):
                copy[at] = f"new{rng.randrange(10**9)}"
            texts.append(copy)
    hot = some(rng, 300)
    texts += [[*hot[:k], f"hot{k}", *hot[k + 1 :]] for k in range(80)]
    ids = rng.sample(range(10_000), len(texts))
    return [(i, " ".join(t), "en", "s", 0) for i, t in zip(ids, texts, strict=True)]


def test_pipeline_drops_copies_of_similarity_080_to_099(spark, copies):
    import corpus_pipeline

    sets = {i: shingles(t) for i, t, *_ in copies}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and similarity(sets[a], sets[b]) >= 0.8]
    assert sum(0.8 <= similarity(sets[a], sets[b]) < 0.9 for a, b in near) > 100
    docs = spark.createDataFrame(copies, DOCS).repartition(3)
    stay = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert not [(a, b) for a, b in near if a in stay and b in stay]
    # what goes has an earlier text that is alike
    assert {b for _, b in near} >= sets.keys() - stay


def test_large_groups_are_thinned_first(spark, copies):
    docs = spark.createDataFrame(copies, DOCS)
    sets = {i: shingles(t) for i, t, *_ in copies}
    stay = [r.doc_id for r in overlap.without_overlap(docs, group=5).collect()]
    assert not [(a, b) for a in stay for b in stay if a < b and similarity(sets[a], sets[b]) >= 0.8]


def test_rows_that_share_an_id(spark):
    rng = random.Random(2)
    one, two = (" ".join(some(rng, 50)) for _ in range(2))
    rows = [(1, one), (5, one + " more"), (5, two), (6, two + " more"), (None, one), (None, one + " x"), (7, None), (8, " \n"), (9, "few words"), (10, "Few  words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.text) for r in overlap.without_overlap(docs).collect()), key=str)
    assert got == sorted([(1, one), (5, one + " more"), (5, two), (7, None), (9, "few words")], key=str)
