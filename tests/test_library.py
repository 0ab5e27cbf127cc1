"""Lists and gates on rows made here."""

import random

from pyspark.sql import functions as F

from lectern.operators import library, organize


def test_pages_from_both_ends(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(103)], "id int, at int")
    want = sorted(((-(i % 7), i) for i in range(103)))
    for number in (1, 2, 5, 9, 11, 50):
        got = organize.page_clamped(rows, [("at", False), ("id", True)], 10, number).orderBy("place").collect()
        use = min(number, 11)
        assert [r.id for r in got] == [i for _, i in want[10 * (use - 1) : 10 * use]]
        assert [r.place for r in got] == list(range(10 * (use - 1) + 1, 10 * (use - 1) + 1 + len(got)))
    assert organize.page_clamped(rows.where("false"), [("id", True)], 10, 3).count() == 0


def test_keyset_paging_meets_all_rows(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(25)], "a int, b int")
    seen, last = [], (-1, -1)
    while part := organize.after_key(rows, ["a", "b"], last, 7).collect():
        seen += [tuple(r) for r in part]
        last = seen[-1]
    assert seen == sorted((i % 3, i) for i in range(25))


def test_readable_lines(spark):
    rows = spark.createDataFrame([("d", i, t) for i, t in enumerate(["-", "first", "plain", "2.", "second"])], "id string, pos int, text string")
    assert [r.text for r in library.readable_lines(rows).orderBy("pos").collect()] == ["- first", "plain", "2. second"]


def test_chunks_cover_the_text(spark):
    rng = random.Random(4)
    body = "".join(rng.choice(["word ", "end. ", "line\n"]) for _ in range(900))
    items = spark.createDataFrame([("a", body), ("b", "short"), ("c", ""), ("d", None)], "id string, body string")
    got = library.chunk_overlap(items).collect()
    own = [r for r in got if r.id == "a"]
    at = 0
    for r in own:
        assert r.start <= at and body[r.start : r.stop].strip() == r.text and r.stop - r.start <= 1200
        assert r.stop == len(body) or r.stop == r.start + 1200 or body[r.stop - 1] == "."
        at = r.stop
    assert at == len(body) and {r.id for r in got} == {"a"} and own[0].chunk_id == "a-C1"


def test_chunks_for_a_question(spark):
    from lectern.operators import retrieval

    rows = [("a", 0, "ing ing", "x"), ("a", 5, "none", "x"), ("a", 9, "ention", "x"), ("b", 0, "none", "ing"), ("b", 5, "none", None)]
    chunks = spark.createDataFrame(rows, "id string, start long, text string, title string")
    scored = retrieval.score_chunks(chunks, ["ention", "ing"])
    assert {(r.id, r.start): r.score for r in scored.collect()} == {("a", 0): 3, ("a", 5): 0, ("a", 9): 6, ("b", 0): 8, ("b", 5): 0}
    pick = lambda **how: {(r.id, r.start) for r in retrieval.select_chunks(scored, **how).collect()}
    assert pick(most=3) == {("a", 9), ("b", 0), ("a", 0)} and pick(most=1) == {("a", 9), ("b", 0)}
    assert pick(per_source=2, most=4) == {("a", 9), ("a", 0), ("b", 0), ("b", 5)}
    terms = spark.createDataFrame([("GPT-4 检索增强 a 3.5",)], "t string").select(retrieval.query_terms(F.col("t"))).first()[0]
    assert terms == ["gpt-4", "3.5", "检索增强", "检索增", "索增强", "检索", "索增", "增强"]


def test_gates(spark):
    rows = spark.createDataFrame([("pdf", ""), ("pdf", "x" * 100), ("png", None), ("txt", "")], "e string, t string")
    assert [r[0] for r in rows.select(library.needs_ocr(F.col("e"), F.col("t"))).collect()] == [True, False, True, False]
    rows = spark.createDataFrame([("一" * 50,), ("一" * 50 + " word" * 90,), ("words",)], "t string")
    assert [r[0] for r in rows.select(library.prose_language_gate(F.col("t"))).collect()] == [True, False, False]


def test_dense_text_in_blocks(spark):
    from lectern.operators import records

    text = " ".join(f"Sentence number {i} is here." for i in range(30)) + " " + "x" * 300
    got = [r.block for r in records.split_dense_text(spark.createDataFrame([("a", text), ("b", "")], "id string, text string")).where("id = 'a'").orderBy("pos").collect()]
    assert " ".join(got) == text and all(len(b) <= 190 for b in got[:-1])


def test_a_week_chooses_one_new_paper(spark):
    from lectern.operators import records

    candidates = spark.createDataFrame([("w1", "p1", True), ("w1", "p2", True), ("w2", "p3", True), ("w3", "p4", False), ("w4", "p9", True)], "week string, id string, chosen boolean")
    status, papers = spark.createDataFrame([("w2", "done")], "week string, status string"), spark.createDataFrame([("p9",)], "id string")
    assert [(r.week, r.id) for r in records.select_candidate(candidates, status, papers).collect()] == [("w1", "p1")]
