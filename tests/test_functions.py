"""Text functions and small operators on rows made here."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import hierarchy, identity, jobs, maintenance, pages, retrieval, search


def values(spark, column, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], f"x {kind}").select(column).collect()]


def test_text(spark):
    x = F.col("x")
    assert values(spark, T.collapse_blanks(x), ["a　 b\n\tc ", None]) == ["a b c", None]
    assert values(spark, T.summary(x, 5, "none"), ["abcdefgh", "abc", " ", None]) == ["abcde…", "abc", "none", "none"]
    assert values(spark, T.literal_contains(x, "100% A_"), ["is 100% a_b", "is 100 a_b", None]) == [True, False, False]
    assert values(spark, T.compact_count(x), ["1.2k", "3m", "1,234", "x", None]) == [1200, 3_000_000, 1234, None, None]
    assert values(spark, T.clock(x), [59.9, 61.0, 3661.0], "double") == ["00:59", "01:01", "01:01:01"]
    assert values(spark, T.clamp(x, 1, 10, 3), ["0", "7.9", "99", "x", None]) == [1, 7, 10, 3, 3]
    assert values(spark, T.iso_week(x), [dt.date(2024, 12, 30), dt.date(2024, 1, 1)], "date") == ["2025-W01", "2024-W01"]
    assert values(spark, T.block_kind(x), ["- a", "A title", "This is a sentence of prose that ends with a stop.", "1 2 3 4 5 6 7 8 9 10 values in a row of the table here: 11 12 13 14 15 16 17 18 19 20 21 22."]) == ["list", "heading", "paragraph", "data"]
    assert values(spark, T.detect_language(x), ["一二三四五六", "three plain words here", "", "12", "字" * 30 + " longishword" * 10, "字" * 80 + " word" * 130, "字" * 25 + " word" * 45]) == ["zh", "en", "unknown", "unknown", "zh", "mixed", "mixed"]
    assert values(spark, T.text_corruption(x), ["a" * 80 + "\uFFFD" * 3, "a" * 80 + "\uFFFD" * 2, "a" * 70 + "\x07" * 9, "a" * 900 + "\uE001" * 50, "\uFFFD" * 50]) == [True, False, False, True, False]
    assert values(spark, T.plain_text(x), ["<p>a &lt;b&gt;</p><script>x<y</script><p>c&amp;amp;</p>"]) == ["a <b>\nc&amp;"]
    assert values(spark, T.strip_markdown(x), ["## A *b* [c](d) ![e](f)"]) == ["A b c e"]
    assert values(spark, T.excerpt(x, "Needle", 20, 5), ["x" * 30 + " needle " + "y" * 30, "none"])[1] is None


def test_identities(spark):
    x = F.col("x")
    assert values(spark, identity.paper_identity(x), ["https://arxiv.org/abs/2401.01234v2", "arXiv:2401.01234", "https://doi.org/10.1000/xyz.", "none", None]) == ["arxiv:2401.01234", "arxiv:2401.01234", "doi:10.1000/xyz", None, None]
    assert values(spark, identity.video_identity(x), ["https://youtu.be/abcdefghijk?t=3", "https://www.youtube.com/watch?a=1&v=abcdefghijk", "https://www.bilibili.com/video/BV1234567890/", "x"]) == ["youtube:abcdefghijk"] * 2 + ["bilibili:BV1234567890", None]
    assert values(spark, identity.repository_identity(x), ["https://github.com/a-b/c.d.git", "github.com/a/b/tree/x", "https://x.y/a/b"]) == ["a-b/c.d", "a/b", None]
    assert values(spark, identity.public_url(x), ["https://a.b/c", "http://10.1.2.3/", "http://u:p@a.b/", "ftp://a.b", "http://172.16.0.1", "http://172.32.0.1", "http://localhost:80/x"]) == [True, False, False, False, False, True, False]


def test_tree(spark):
    rows = [("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y"), ("d", "a", "b")]
    folders = spark.createDataFrame(rows, "id string, parent_id string, name string")
    assert {tuple(r) for r in hierarchy.folder_paths(folders).collect()} == {("a", 1, "A"), ("b", 2, "A/B"), ("c", 3, "A/B/C"), ("d", 2, "A/b")}
    assert {r.id for r in hierarchy.folder_cycles(folders).collect()} == {"x", "y"}
    assert [(r.parent_id, r.name) for r in hierarchy.sibling_name_conflicts(folders).collect()] == [("a", "b")]
    placed = spark.createDataFrame([("c",), ("c",), ("b",)], "folder_id string")
    got = {r.id: (r.direct, r.below, r.children) for r in hierarchy.folder_rollup(folders, placed).collect()}
    assert got["a"] == (0, 3, 2) and got["b"] == (1, 3, 1) and got["c"] == (2, 2, 0)


def test_deep_trees_and_loops(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, str(i)) for i in range(45)] + [("p", "r", "P"), ("q", "p", "Q"), ("r", "q", "R"), ("below", "p", "B")]
    folders = spark.createDataFrame(rows, "id string, parent_id string, name string")
    assert {r.id: r.depth for r in hierarchy.folder_paths(folders).collect()} == {f"n{i}": i + 1 for i in range(45)}
    closure = {(r.ancestor, r.descendant): r.distance for r in hierarchy.folder_closure(folders).where("descendant LIKE 'n%'").collect()}
    assert closure == {(f"n{i}", f"n{j}"): j - i for j in range(45) for i in range(j + 1)}
    assert {r.id for r in hierarchy.folder_cycles(folders).collect()} == {"p", "q", "r"}


def test_ranks_of_hot_groups(spark):
    from lectern.operators.ranks import ranked

    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), rng.randint(0, 9), i) for i in range(600)]
    got = ranked(spark.createDataFrame(rows, "g string, x int, i int").repartition(5), ["g"], [F.col("x").desc(), F.col("i")]).collect()
    for g in (None, "a", "b"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert {r.i: r["rank"] for r in got if r.g == g} == {r[2]: n for n, r in enumerate(own, 1)}
    assert {r.i: r["rank"] for r in ranked(spark.createDataFrame(rows, "g string, x int, i int"), [], [F.col("i")]).collect()} == {i: i + 1 for i in range(600)}


def test_whole_quotes(spark):
    from lectern.operators.retrieval import quoted_passages

    quotes = spark.createDataFrame([(1, "a b  c d e f"), (2, "two words"), (3, "x"), (4, ""), (5, None), (6, "a b c d e g")], "item_id int, text string")
    bodies = spark.createDataFrame([("p", "z a b c d e\nf a b c d e f two"), ("q", "two  words x x"), ("r", None)], "id string, body string")
    assert {tuple(r) for r in quoted_passages(quotes, bodies).collect()} == {(1, "p", 2), (2, "q", 1), (3, "q", 3)}


def test_links_and_json(spark):
    from lectern.operators import links

    rows = spark.createDataFrame([("http://a.b/c/d", "../x y"), ("http://a.b", "?q"), (None, "/x"), ("http://a.b", None), ("http://[bad", "x"), ("http://a.b", "data:text/plain,x")], "b string, h string")
    assert [r[0] for r in rows.select(links.resolve_links(F.col("b"), F.col("h"))).collect()] == ["http://a.b/x y", "http://a.b/?q", None, None, None, None]
    assert values(spark, links.embedded_json(F.col("x"), "v ="), ['v = {"a": "}"} rest }', 'w = {"a": 1}', 'v = {"a": 1', None, 'v = [1] {"b": {"c": 2}}']) == ['{"a": "}"}', None, None, None, '{"b": {"c": 2}}']


def test_jobs(spark):
    rows = spark.createDataFrame([(1, None), (2, "7"), (9, None), (1, "99999"), (1, "soon")], "n int, told string")
    now = F.lit("2015-10-21 07:27:00").cast("timestamp")
    assert [r[0] for r in rows.select(jobs.retry_delay(F.col("n"), jobs.retry_after(F.col("told"), now))).collect()] == [30_000, 7_000, 1_800_000, 3_600_000, 30_000]
    dates = ["Wed, 21 Oct 2015 07:28:00 GMT", "Tue, 20 Oct 2015 07:28:00 GMT", "0.2", "-5", "", None, "Infinity"]
    assert values(spark, jobs.retry_after(F.col("x"), now), dates) == [60_000, 1_000, 1_000, None, None, None, None]
    rows = spark.createDataFrame([(429, ""), (404, "Socket hang up"), (400, "no"), (None, None), (503, None), (600, "timeout"), (None, "HTTP 502"), (None, "HTTP 404"), (None, "connection timed out")], "s int, m string")
    assert [r[0] for r in rows.select(jobs.transient(F.col("s"), F.col("m"))).collect()] == [True, True, False, False, True, False, True, False, True]
    day = dt.datetime(2024, 1, 1)
    reviews = spark.createDataFrame([("c", 1, day, "good"), ("c", 2, day, "easy"), ("c", 3, day, "hard"), ("c", 4, day, "again"), ("c", 5, day, "what")], "card_id string, seq long, ts timestamp, rating string")
    assert tuple(jobs.review_schedule(reviews).first()) == ("c", 2, 2.4, 5, 19725)
    many = spark.createDataFrame([(None, n, day, "easy") for n in range(40)], "card_id string, seq long, ts timestamp, rating string")
    got = jobs.review_schedule(many).first()
    assert got["ease"] == 3.2 and got["due"] <= jobs.LAST_DAY and got["reviews"] < 40
    assert jobs.review_schedule(many.where("false")).count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, " "), (3, "c")], "k int, v string")
    merged = maintenance.upsert_by_policy(old, new, ["k"], {"v": maintenance.nonblank})
    assert {tuple(r) for r in merged.collect()} == {(1, "a"), (2, "b"), (3, "c")}
    unknown = spark.createDataFrame([(9, "x", 1)], "k int, v string, o int")
    kept = maintenance.batch_assign(old, unknown, old, ["k"], ["o"])
    assert {tuple(r) for r in kept.collect()} == {(1, "a"), (2, "b")}


def test_snapshots_keep_the_last_good_version(spark, tmp_path):
    store = maintenance.Snapshots(spark, f"file://{tmp_path}/t")
    store.publish(spark.createDataFrame([(1,)], "k int"), {"positive": F.col("k") > 0})
    with pytest.raises(ValueError, match="positive"):
        store.publish(spark.createDataFrame([(2,), (-1,), (None,)], "k int"), {"positive": F.col("k") > 0})
    assert [r.k for r in store.read().collect()] == [1] and store.number() == 1
    for k in range(2, 13):  # published within one tick of a clock, more than nine
        store.publish(spark.createDataFrame([(k,)], "k int"))
        assert [r.k for r in store.read().collect()] == [k] and store.number() == k


def test_search_pages(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(25)], "id int, at int")
    got = search.paged(rows, [F.col("at").desc(), "id"], 10, 20).collect()
    assert [(r.place, r.total, r.has_more) for r in got] == [(p, 25, False) for p in range(21, 26)]
    assert search.paged(rows, ["id"], 10, 100).count() == 0


def test_fallback_hits(spark):
    hits = spark.createDataFrame([("d", "1", "title", "x")], "target_type string, target_id string, field string, excerpt string")
    notes = spark.createDataFrame([("d", "1", "the word", dt.datetime(2024, 1, 1)), ("d", "2", "a word", dt.datetime(2024, 1, 1)), ("d", "2", "new word", dt.datetime(2024, 1, 2)), ("d", "3", "none", dt.datetime(2024, 1, 2))], "target_type string, target_id string, note_text string, updated_at timestamp")
    got = {(r.target_id, r.field, r.excerpt) for r in search.fallback_hits(hits, notes, "WORD").collect()}
    assert got == {("1", "title", "x"), ("2", "note", "new word")}


def test_forged_quotes_fall(spark):
    chunks = spark.createDataFrame([("a-C1", "the quick  brown fox")], "chunk_id string, text string")
    cited = spark.createDataFrame([("q", "a-C1", "quick brown"), ("q", "a-C1", "quick red fox"), ("q", "a-C1", "fox"), ("p", "a-C9", "the quick")], "answer_id string, chunk_id string, quote string")
    valid = retrieval.citation_join(cited, chunks)
    assert [r.quote for r in valid.collect()] == ["quick brown"]
    assert {tuple(r) for r in retrieval.insufficient_evidence(cited, valid).collect()} == {("q", 1, False), ("p", 0, True)}


def test_embedded_images(spark):
    rows = spark.createDataFrame([(1, '<img src="data:image/png;base64,AAEC"><img src="x.png">')], "page_id long, html string")
    assert [(r.kind, r.bytes) for r in pages.embedded_images(rows).collect()] == [("png", 3)]
