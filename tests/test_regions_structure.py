"""Page regions and article structure on rows made here."""

from pyspark.sql import functions as F

from lectern.operators import articles, regions, structure

ROWS = "doc_id string, page int, row_y double, left double, right double, text string"


def test_regions(spark):
    lines = [("d", 1, 20.0, 300.0, 310.0, "7"), ("d", 1, 60.0, 50.0, 280.0, "left text"), ("d", 1, 60.5, 320.0, 560.0, "right text"), ("d", 1, 100.0, 50.0, 500.0, "Table 1: numbers")]
    lines += [("d", 1, 112.0 + 12 * i, 50.0, 500.0, f"row {i}") for i in range(6)]
    lines += [("d", 1, 220.0, 50.0, 500.0, "after the table"), ("d", 1, 400.0, 50.0, 500.0, "Figure 2. A view"), ("d", 1, 420.0, 50.0, 500.0, "end one"), ("d", 1, 432.0, 50.0, 500.0, "end two")]
    rows = spark.createDataFrame(lines, ROWS)
    parts = {r.text: r.part for r in regions.columns_of(rows).collect()}
    assert (parts["left text"], parts["right text"], parts["after the table"]) == ("left", "right", "body") and "7" not in parts
    tables = regions.table_regions(rows)
    assert [(r.top, r.bottom, r.rows) for r in tables.collect()] == [(100.0, 172.0, 6)]
    free = {r.text for r in regions.text_outside_tables(rows, tables).collect()}
    assert "[table] Table 1: numbers" in free and "row 3" not in free and "after the table" in free
    figures = regions.figure_regions(rows)
    assert [(r.top, r.bottom) for r in figures.collect()] == [(220.0, 400.0)]
    flow = regions.reading_flow(rows, figures).orderBy("piece").collect()
    assert [r.kind for r in flow] == ["text", "figure", "text"] and flow[2].text == "end one\nend two"


def test_scope_and_figures(spark):
    html = "<h1>A</h1><p>" + "x " * 300 + "</p><h2>B</h2><p>" + "y " * 300 + "</p>"
    blocks = articles.html_blocks(spark.createDataFrame([(1, html), (2, "<p>only this</p>")], "page_id long, html string"))
    assert {r.page_id: r.scope for r in structure.paper_scope(blocks).collect()} == {1: "fulltext", 2: "abstract_only"}
    article = spark.createDataFrame([(1, "A  view", None), (1, "Other", "o.png"), (1, "None", None)], "page_id long, caption string, src string")
    source = spark.createDataFrame([(1, "a view", "v.png"), (1, "none", "o.png")], article.schema)
    assert {(r.caption, r.src) for r in structure.restore_figures(article, source).collect()} == {("A  view", "v.png"), ("Other", "o.png"), ("None", None)}
    images = spark.createDataFrame([(1, "i.png", 2)], "page_id long, src string, n int")
    text = spark.createDataFrame([(1, 5, "one"), (1, 9, "two")], "page_id long, pos int, text string")
    assert [r.text or r.src for r in structure.merge_images_by_position(images, text).orderBy("pos").collect()] == ["one", "i.png", "two"]


def test_tables_and_outlines(spark):
    cells = spark.createDataFrame([("t", 0, 0, None), ("t", 1, 0, 99), ("t", 1, 1, 0), ("t", 1, 2, None)], "table_id string, row int, col int, span int")
    assert [(r.row, r.span) for r in structure.repair_table_spans(cells).orderBy("row", "col").collect()] == [(0, 3), (1, 20), (1, 1), (1, 1)]
    outline = spark.createDataFrame([("d", i, f"c{i}", p) for i, p in enumerate([1, 9, 3, 5, 4, 8])], "doc_id string, place int, title string, page int")
    got = structure.outline_chapters(outline).orderBy("place").collect()
    assert [r.page for r in got] in ([1, 3, 4, 8], [1, 3, 5, 8]) and got[-1].last_page == 8 and got[0].last_page == 2


def test_markdown_links_and_profiles(spark):
    rows = spark.createDataFrame([("a", "T", "# T\n\n" + "some **bold** text with [a link](x.md). " * 8), ("b", "S", "short")], "id string, title string, text string")
    got = structure.markdown_to_article(rows).collect()
    assert [r.id for r in got] == ["a"] and "bold text with a link." in got[0].body and got[0].language == "en"
    links = spark.createDataFrame([("./a/b.md#x",), ("http://x/y",), ("../up.md",), ("/c.md",)], "h string").select(structure.resolve_chapter_link(F.lit("http://s/base/"), F.col("h"))).collect()
    assert [r[0] for r in links] == ["http://s/base/a/b.md", None, None, "http://s/base/c.md"]
    folder = spark.createDataFrame([("Deep Rust", "/x"), ("Other", "/python/1"), ("No", "/")], "t string, r string").select(structure.recommend_folder(F.col("t"), F.col("r"), [("rust", "R"), ("python", "P")], "Inbox")).collect()
    assert [r[0] for r in folder] == ["R", "P", "Inbox"]
    files = spark.createDataFrame([("r", "src/a.py", 5), ("r", "src/b.py", 7), ("r", "docs/c.md", 1), ("r", "setup.py", 1)], "repository string, path string, bytes long")
    assert tuple(structure.repository_profile(files, [("python", r"\.py$"), ("rust", r"\.rs$")]).first()) == ("r", 4, 14, "src,docs", "python")


def test_parts_and_transcripts(spark):
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["[page 1]"] + ["x" * 30] * 9)], "id string, pos int, text string")
    parts = structure.split_oversize(lines, 100).orderBy("part").collect()
    assert all(p.text.startswith("[page 1]") for p in parts) and sum(p.text.count("x") for p in parts) == 270
    segments = spark.createDataFrame([("v", 2.0, "second part here"), ("v", 1.0, "first part here")], "video_id string, start double, text string")
    assert tuple(structure.transcript_article(segments).first()) == ("v", "first part here second part here", "first part here second part here", "en", 2)
    notes = spark.createDataFrame([("n", "<p>a<br>b</p><ul><li>c</ul><img alt='pic' src=x>")], "id string, html string")
    assert structure.note_plain_text(notes).first().text == "a b\nc\n[pic]"
