"""Operators over pages, urls and vectors, and the pipeline."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from lectern.llm import bit_sliced, url_filter, warc
from lectern.llm.common import settle

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("classes", [warc.CLASSES, ((10, 2), (400, 1), (None, 1))])
def test_warc_round_trip(spark, monkeypatch, classes):
    monkeypatch.setattr(warc, "CLASSES", classes)
    page = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(1, "http://a/1", page), (2, "http://a/2 x\r\ny", page), (3, None, page), (4, "u", ""), (5, "u", None), (6, "u", "short"), (7, "u", "short"), (8, "u", "y" * 100), (9, "u", "y" * 100), (None, "u", "y" * 100), (10, "u", "z" * 99), (11, "u", "z" * 99), (3, "v", "other" * 50), (3, "v", "other" * 50)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    got = warc.through_archives(pages).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and i != first[h or ""]
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.intact for r in got)
    assert {r.payload for r in got if r.page_id == 1} == {page}
    assert warc.through_archives(pages.where("false")).count() == 0


def test_url_parts_and_rules(spark):
    rows = [
        ("http://WWW.Example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("https://x.net/es/a", "x.net", "/es/a", "net/es/", "block"),
        ("https://com", "com", "", None, "allow"),
        ("https://x.org?a=://b.net/es/", "x.org", "", None, "allow"),
        ("nothing", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, r[0], "t") for i, r in enumerate(rows)], "page_id long, url string, tokens string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judged_urls(pages, confidence=1.0, support=0.9).collect()}
    for i, (_, *want) in enumerate(rows):
        assert got[i][:3] == tuple(want[:3]), rows[i]
        if want[2]:
            assert got[i][3] == want[3]
    assert url_filter.judged_urls(pages.where("false")).count() == 0


def test_mined_rules_match_by_brute_force(spark):
    rng = random.Random(2)
    urls = [f"https://{rng.choice('abc')}.{rng.choice(['one', 'two', 'six'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr'])}/{rng.randint(1, 99)}" for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judged_urls(pages, support=0.01, confidence=0.6).collect()
    url = __import__("pyspark.sql.functions", fromlist=["col"]).col("url")
    host, path = url_filter.host_of(url), url_filter.path_of(url)
    tokens = {r[0]: frozenset(r[1]) for r in pages.select("page_id", url_filter.tokens_of(url, host, path)).collect()}
    fixed = {r.page_id: r.verdict for r in got if r.rule}
    rules = {}
    from itertools import combinations

    total = len(fixed)
    seen, hits = Counter(), Counter()
    for i, v in fixed.items():
        for n in range(1, len(tokens[i]) + 1):
            for c in combinations(sorted(tokens[i]), n):
                seen[c] += 1
                hits[c, v] += 1
    for (c, v), n in hits.items():
        if n / total >= 0.01 and n / seen[c] >= 0.6:
            rules[frozenset(c), v] = (n / seen[c], n / total, len(c))
    for r in got:
        if r.rule is None:
            fit = [(*s, v) for (c, v), s in rules.items() if c <= tokens[r.page_id]]
            # pruned rules are no surer than those that stay
            assert not fit or max(fit)[0] == pytest.approx(max(x[0] for x in fit if x[3] == r.verdict))


def slow_top(rows, k):
    use = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(c)) for i, c in use if i % 100 == 0}:
        found = sorted((-int(np.dot(a, c)), i) for i, c in use if i != q and len(c) == len(a))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("rows", [4096, 50])
def test_top_products_against_brute_force(spark, rows):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 9)]) for i in range(420)]
    vectors += [(500, None), (600, []), (610, []), (1000, []), (611, []), (601, [1.0, None] + [0.0] * 7), (602, [float("nan")] * 9), (603, [float("inf")] * 9), (None, [1.0] * 9), (700, [0.0] * 9), (701, [0.5] * 3), (800, [0.25] * 3), (702, [0.0] * 9)]
    vectors += [(900 + i, vectors[5][1]) for i in range(20)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, score string").repartition(3)
    got = {tuple(r) for r in bit_sliced.top_products(df, rows=rows, queries=3).collect()}
    assert got == slow_top(vectors, 10)
    assert bit_sliced.top_products(df.where("false")).count() == 0


def test_top_products_of_large_numbers(spark):
    vectors = [(0, [3e5, -2e5]), (1, [3e5, 1.0]), (2, [-4e5, 2e5]), (3, [1e-3, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in bit_sliced.top_products(df).collect()} == slow_top(vectors, 10)
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in bit_sliced.top_products(huge).orderBy("rank").collect()] == [1, 2]


def test_near_scores_of_large_numbers_are_told_apart():
    codes = np.array([(2**31, i) for i in range(6)], np.int64)
    made = bit_sliced.Slices(codes)
    q, r, score = made.best(np.array([(2**31, 1)], np.int64), np.array([100]), np.arange(6), 2)
    assert r.tolist() == [5, 4] and score.tolist() == [2**62 + 5, 2**62 + 4] and q.tolist() == [0, 0]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = settle(stage(spark, before, SMALL), "test")
        assert after.columns == columns, name
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in before.select("doc_id").collect()}
        before = after
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = corpus_pipeline.good_quality(spark, docs, SMALL)
    # some seventy labels teach it, of which a dozen are of bad documents
    wrong = good.join(labels, "doc_id").where("quality = 0").count() + docs.join(labels, "doc_id").where("quality = 1").join(good, "doc_id", "left_anti").count()
    assert wrong <= 0.05 * labels.count()
    packed = corpus_pipeline.packing(spark, before, SMALL)
    total = packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("`sum(length)` <> `max(doc_tokens)`")
    assert total.count() == 0 and packed.select("doc_id").distinct().count() == before.count()
    assert corpus_pipeline.run(spark, SMALL).count() == packed.count()


ODD = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "s", 3), (None, "c d", "en", "s", 3), (2, "é" * 200, "fr", None, 200), (3, "é" * 200 + "x", "fr", "s", 201), (4, "", "en", "s", 0), (5, "w " * 40_000, "en", "http://h/p", 80_000)]
CLASHES = ("score", "predicted", "held_out", "_host", "_path", "host", "path", "id", "own", "stays", "label_id", "carry", "kept", "node", "_stays", "_own_sha", "key", "doc", "bytes")


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    plain = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    named = spark.createDataFrame([(*r[:2], *(f"{c}{n}" for c in CLASHES)) for n, r in enumerate(ODD)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))
    for docs in (plain, named, plain.select("doc_id", "text")):
        rows = Counter((r[0], r[1] or "") for r in docs.collect())
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, docs, SMALL)
            assert left.columns == docs.columns, name
            got = left.collect()
            if name != "suffix-array dedup":  # that one cuts texts
                assert not Counter((r[0], r[1] or "") for r in got) - rows, name
            for r in got if docs is named else []:
                assert len({r[c][len(c) :] for c in CLASHES}) == 1 and all(r[c].startswith(c) for c in CLASHES), name
        packed = corpus_pipeline.packing(spark, docs, SMALL)
        assert packed.agg({"length": "sum"}).first()[0] > 0
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs.where("false"), SMALL).count() == 0, name
    left = {(r.doc_id, r.text): r.n_chars for r in corpus_pipeline.repeated_passages(spark, plain, SMALL).collect()}
    assert all(n == len(t) for (_, t), n in left.items())
