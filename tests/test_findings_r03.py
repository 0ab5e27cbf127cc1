"""What the third review found, on tables made for it."""

import datetime

import pytest

from lectern.plans.registry import QUERIES, SQL


def against_sql(spark, folder, name, **tables):
    """Rows of a query, sorted, which must be those of its SQL."""
    import duckdb

    made = duckdb.connect()
    made.sql("SET TimeZone = 'UTC'")
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = QUERIES[name](spark, str(folder))
    want = made.sql(SQL[name])
    shown = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    found = shown(got.select(*want.columns).collect())
    assert found == shown(want.fetchall())
    return found


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_f1_documents_without_letters_have_no_word(spark, tmp_path):
    rows = [(1, "12 34", "en", "s", 5), (2, "", "en", "s", 0), (3, "7 abc d", "en", "s", 7), (4, None, "en", "s", 0), (6, "abc", "en", "s", 3)]
    found = against_sql(spark, tmp_path, "read_ocr_tsv", documents=(rows, DOCUMENTS))
    assert [r[-1] for r in found] == ["abc"]


def test_f2_upper_case_of_one_letter_may_be_two(spark, tmp_path):
    rows = [(1, "straße ﬁn"), (7, "ŉ"), (5, None), (3, "plain"), (11, "  ")]
    found = against_sql(spark, tmp_path, "upsert_papers", benchmark=(rows, "item_id long, text string"))
    assert {"STRASSE FIN", "ʼN", "PLAIN"} <= {x for r in found for x in r}


def test_f3_open_and_late_sessions_are_in(spark, tmp_path):
    at = lambda day, hour: datetime.datetime(2024, 1, day, hour)
    first = [(1, 1, at(1, 0)), (2, 1, at(1, 23)), (3, 2, at(20, 0)), (4, 1, at(20, 5))]
    late = [(5, 1, at(1, 12)), (6, 3, at(2, 0)), (7, 2, at(20, 12)), (8, 2, at(21, 1))]
    schema = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double"
    rows = lambda some: [(n, u, t, "view", 1.0) for n, u, t in some]
    spark.createDataFrame(rows(late), schema).coalesce(1).write.parquet(f"{tmp_path}/more")
    folder = tmp_path / "events.parquet"
    spark.createDataFrame(rows(first), schema).coalesce(1).write.parquet(str(folder))
    for i, f in enumerate((tmp_path / "more").glob("part-*.parquet")):
        f.rename(folder / f"part-z{i}.parquet")
    found = {r.owner_id: (r.sessions, r.ticks) for r in QUERIES["stream_sessions"](spark, str(tmp_path)).collect()}
    assert found == {1: (2, 4), 2: (2, 3), 3: (1, 1)}
    assert "max(ts)" not in SQL["stream_sessions"]


def passes(spark, column):
    """How often a plan takes blanks out of a text."""
    from pyspark.sql import functions as F

    from lectern.functions.text import BLANKS

    df = spark.createDataFrame([("a b",)], "t string").select(column(F.col("t")).alias("x"))
    return df._jdf.queryExecution().optimizedPlan().toString().count(BLANKS[:-1])


def test_f4_a_text_layer_is_walked_once_a_class(spark):
    from lectern.functions.text import text_corruption

    assert passes(spark, text_corruption) == 1


def test_f9_a_language_is_told_from_counts_made_once(spark):
    from lectern.functions.text import detect_language

    assert passes(spark, detect_language) == 1


@pytest.mark.parametrize("name", ["ocr_lines", "ocr_pages", "group_text_rows", "join_row_text"])
def test_f5_to_f8_f12_f14_words_of_a_page_stay_together(spark, tmp_path, name):
    """Also: empty lines and words, a page without words, lines after it, a text without any."""
    rows = [(1, "a b,  c\n\n x\n", "en", "s", 9), (2, "\n" * 45 + "late one", "en", "s", 53), (3, " \n ", "en", "s", 3), (4, None, "en", "s", 0)]
    assert against_sql(spark, tmp_path, name, documents=(rows, DOCUMENTS))
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_single_words_in_any_order_make_the_same_lines(spark):
    from pyspark.sql import functions as F

    from lectern.operators import layout

    words = spark.createDataFrame([("d", 1, 1, 1, 2, 1, "end", 5), ("d", 1, 1, 1, 1, 2, "b", None), ("d", 2, 1, 1, 1, 1, "x", 1), ("d", 1, 1, 1, 1, 1, "a", 7)], "doc_id string, page_num int, block_num int, par_num int, line_num int, word_num int, text string, conf long")
    whole = layout.ocr_page_words(words)
    none = whole.select(F.lit("e").alias("doc_id"), "page_num", F.slice("items", 1, 0).alias("items"))
    for form in (words, whole.unionByName(none)):
        assert {(r.page_num, r.line_num, r.text, r.words, r.conf) for r in layout.ocr_lines(form).collect()} == {(1, 1, "a b", 2, 7), (1, 2, "end", 1, 5), (2, 1, "x", 1, 1)}
    for form in (layout.ocr_lines(words), whole.unionByName(none)):
        assert {tuple(r) for r in layout.ocr_pages(form).collect()} == {("d", 1, "a b\nend", 3, 12), ("d", 2, "x", 1, 1)}


def test_f13_pages_are_parsed_a_few_at_a_time(spark):
    """Block rows go out page by page of a batch, not when many are there."""
    from lectern.operators import articles

    pages = spark.range(0, 450, 1, 1).selectExpr("id AS page_id", "IF(id = 7, '', concat('<p>', id, '</p><p>b</p>')) AS html")
    rows = articles.html_blocks(pages)
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.page_id, r.pos, r.text, r.font) for r in rows.collect()) == sorted((n, i, t, None) for n in range(450) if n != 7 for i, t in enumerate((str(n), "b")))


def test_f10_texts_of_pages_move_once_a_step(spark):
    """Scores are added up by hashing, without texts; a page's blocks are dealt once to find its
    region, once to find its promotions, and the rows are those of a page that has both."""
    from lectern.operators import articles, page_regions

    long = "A paragraph of the text, long enough to count among what is read, without any link at all. "
    html = f"<html><body><nav><p>{long}</p></nav><div class=article><h1>T</h1><p>{long * 2}</p><p>{long}</p><div><p>扫码关注</p></div></div></body></html>"
    pages = spark.createDataFrame([(n, f"http://a/{n}", html) for n in range(3)], "page_id long, url string, html string")
    blocks = articles.html_blocks(pages)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan(page_regions.scores(blocks))
    with_text = lambda df: sum("Exchange" in line for line in plan(df).split("\n"))
    main = page_regions.main_content(blocks)
    assert with_text(main) <= 2 and {r.text for r in main.collect()} == {"T", (long * 2).strip(), long.strip(), "扫码关注"}
    clean = page_regions.drop_promotions(main)
    assert {r.text for r in clean.collect()} == {"T", (long * 2).strip(), long.strip()}
    assert {tuple(r) for r in articles.pages_to_articles(pages).select("page_id", "language", "blocks").collect()} == {(n, "en", 3) for n in range(3)}


def test_f11_small_files_are_one_batch_and_only_illegal_events_are_written(spark, tmp_path):
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"
    rows = [(order, order + line, 7, line, float(line), "ARN"[(order + line) % 3]) for order in range(9) for line in range(1, 5)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    with pytest.MonkeyPatch.context() as m:
        from lectern.plans import streams

        m.setattr(streams, "shared_path", lambda spark, name: f"{tmp_path}/{name}")
        got = {r.job_id: (r.status, r.illegal) for r in QUERIES["stream_job_state"](spark, str(tmp_path)).collect()}
    want = {}
    for order in range(9):
        status, illegal = "", 0
        for line in range(1, 5):
            for new in ("running", {"A": "completed", "R": "failed", "N": "queued"}["ARN"[(order + line) % 3]]):
                follows = {"": ("queued", "running"), "queued": ("running", "failed"), "running": ("completed", "failed", "queued", "running"), "failed": ("queued",), "completed": ()}
                status, illegal = (new, illegal) if new in follows[status] else (status, illegal + 1)
        want[str(order)] = (status, illegal)
    assert got == want
    assert {p.name for p in (tmp_path / "jobs" / "told").glob("batch=*")} == {"batch=-1", "batch=0"}
    told = spark.read.parquet(f"{tmp_path}/jobs/told").where("NOT _is_state")
    assert told.where("legal").count() == 0 and told.count() == sum(n for _, n in want.values()) > 0
