"""Files and markup, positioned text, and streams against their batch twins."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import layout
from lectern.sources import files
from lectern.streaming import reading


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.html").write_text("<p>x &amp; y</p><script>z</script>")
    (tmp_path / "c.bin").write_bytes(b"\0\1")
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.txt").write_text("")
    (tmp_path / "g.txt").write_text("  ")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:d xmlns:w='u'><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:d>")
    (tmp_path / "d.docx").write_bytes(out.getvalue())
    got = {r.name: (r.text, r.status) for r in files.extract_file_text(files.read_files_bytes(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": ("hello", "complete"), "b.html": ("x & y", "complete"), "c.bin": ("", "unsupported"), "d.docx": ("one\ntwo", "complete"), "e.docx": ("", "failed:BadZipFile"), "g.txt": ("", "empty")}


def test_ocr(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "x.tsv").write_text(head + "4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t1\t2\t5\t0\t4\t9\t120\tworld\n5\t1\t1\t1\t1\t1\t0\t0\t4\t9\t80\t\"hello\n5\t1\t1\t1\t2\t1\t0\t9\t4\t9\t-1\tend\n5\t2\t1\t1\t1\t1\t0\t9\t4\t9\t50\t \n")
    words = files.read_ocr_tsv(spark, str(tmp_path / "x.tsv")).withColumn("doc_id", F.lit("d"))
    pages = layout.ocr_pages(layout.ocr_lines(words))
    doc = layout.ocr_documents(pages).first()
    assert (doc.text, doc.pages, doc.confidence) == ('[page 1]\n"hello world\nend', 1, 60.0)
    (tmp_path / "y.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError, match="conf"):
        files.read_ocr_tsv(spark, str(tmp_path / "y.tsv"))


def test_captions(spark):
    json3 = '{"events":[{"tStartMs":0,"dDurationMs":1500,"segs":[{"utf8":"a"},{"utf8":" b"}]},{"tStartMs":2000},{"tStartMs":3000,"dDurationMs":500,"segs":[{"utf8":"a b"}]},{"tStartMs":4000,"segs":[{"utf8":"c"}]}]}'
    rows = files.caption_json3(spark.createDataFrame([("v", json3), ("w", "not json")], "video_id string, payload string"))
    assert [(r.start, r.duration, r.text) for r in rows.collect()] == [(0.0, 1.5, "a b"), (3.0, 0.5, "a b"), (4.0, 0.0, "c")]
    assert [r.start for r in layout.dedup_consecutive_captions(rows).orderBy("start").collect()] == [0.0, 4.0]
    xml = '<t><text start="1.5" dur="2">it&amp;#39;s</text><p t="3000" d="500">x <b>y</b></p></t>'
    got = [(r.start, r.duration, r.text) for r in files.caption_timedtext(spark.createDataFrame([("v", xml)], "video_id string, payload string")).collect()]
    assert got == [(1.5, 2.0, "it&#39;s"), (3.0, 0.5, "x y")]
    windows = spark.createDataFrame([("v", 0.0, 1.0), ("v", 3.2, 200.0)], "video_id string, w_start double, w_end double")
    spans = rows.select("video_id", "start", (F.col("start") + F.col("duration")).alias("end"), "text")
    assert {(r.w_start, r.text) for r in layout.segments_in_window(windows, spans).collect()} == {(0.0, "a b"), (3.2, "a b c")}
    tracks = spark.createDataFrame([("v", "en-GB", False), ("v", "en", True), ("w", "de", False), ("w", "fr", False)], "video_id string, language string, automatic boolean")
    assert {(r.video_id, r.language) for r in layout.choose_caption_track(tracks, ["fr", "en"]).collect()} == {("v", "en"), ("w", "fr")}


def test_markup(spark):
    feed = "<feed><entry><id>http://x/2401.1v3</id><title>A\n B</title><summary>s</summary><published>2024</published></entry></feed>"
    assert tuple(files.atom_entries(spark.createDataFrame([(feed,)], "payload string")).first()) == ("http://x/2401.1", "A B", "s", "2024")
    page = '<meta name="citation_title" content="T"><meta name="citation_author" content="A"><meta name="citation_author" content="B">'
    got = files.abstract_page_metadata(spark.createDataFrame([("u", page), ("v", "none")], "url string, html string")).collect()
    assert [(r.url, r.title, r.authors) for r in got] == [("u", "T", ["A", "B"])]
    side = "* **Part one**\n  * [One](one.md)\n  * [Two](two.md)\n* Part two\n  * [Again](one.md)\n  * [Three](c/three.md)\n"
    sites = spark.createDataFrame([("s", side, "[Two](two.md) [Four](four.md)")], "site string, sidebar string, readme string")
    rows = files.markdown_sidebar(sites)
    assert [(r.order, r.group, r.title) for r in rows.orderBy("order").collect()] == [(1, "Part one", "One"), (2, "Part one", "Two"), (3, "Part two", "Three")]
    assert [r.href for r in files.readme_chapters(sites, rows.select("site", "href")).collect()] == ["four.md"]
    table = "## List\n| Day | Paper |\n|---|---|\n| 2024-01-01 | [T](http://u) |\n| x | y |\n## Next\n| 2024-01-02 | Z |"
    got = files.markdown_table(spark.createDataFrame([("p", table)], "page string, text string"), "List").collect()
    assert [(r.day, r.title, r.url, len(r.id)) for r in got] == [("2024-01-01", "T", "http://u", 24)]


def test_rows_of_a_page(spark):
    items = spark.createDataFrame([("d", 1, 10.0, 100.2, 20.0, 10.0, "hel"), ("d", 1, 30.1, 100.4, 20.0, 10.0, "lo"), ("d", 1, 60.0, 99.9, 20.0, 10.0, "there"), ("d", 1, 10.0, 120.0, 20.0, 6.0, "small"), ("d", 1, None, 1.0, 1.0, 1.0, "no")], "doc_id string, page int, x double, y double, width double, font_size double, str string")
    rows = layout.text_rows(items)
    assert {(r.row_y, r.text) for r in rows.collect()} == {(100, "hello there"), (120, "small")}
    assert layout.tiny_lines(rows).first().tiny == 1
    columns = [("d", 1, x, float(y), 200.0, 9.0, "t") for y in range(10) for x in (50.0, 330.0)]
    assert layout.layout_complexity(spark.createDataFrame(columns, items.schema)).first().columns


def test_lines(spark):
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["a long-", "winded text", "一二", "三四", "end"])], "id string, pos int, text string")
    assert layout.join_lines(lines).first().text == "a longwinded text 一二三四 end"
    rows = spark.createDataFrame([("d", i, t) for i, t in enumerate(["front", "# One", "text", "## Sub", "# Two", "more"])], "id string, pos int, text string")
    assert [(r.place, r.title, r.first, r.last) for r in layout.chapters(rows).orderBy("place").collect()] == [(0, None, 0, 0), (1, "One", 1, 3), (2, "Two", 4, 5)]
    heads = spark.createDataFrame([("1.2 Scope",), ("5 % of all",), ("Chapter IV the end",), ("plain text",)], "x string").select(layout.heading(F.col("x")).alias("h")).collect()
    assert [h.h and h.h.level for h in heads] == [2, None, 1, None]
    toc = spark.createDataFrame([("Intro ..... 12",), ("none 12",)], "x string").select(layout.toc_line(F.col("x")).alias("t")).collect()
    assert tuple(toc[0].t) == ("Intro", 12) and toc[1].t is None


def test_packs_and_runs(spark):
    rng = random.Random(1)
    blocks = [("d", i, rng.randint(1, 50)) for i in range(60)]
    got = {r.pos: r.section for r in layout.section_pack(spark.createDataFrame(blocks, "id string, pos int, size long"), 100).collect()}
    used = section = 0
    for _, i, n in blocks:
        if used and used + n > 100:
            used, section = 0, section + 1
        used += n
        assert got[i] == section
    rows = spark.createDataFrame([("d", i, v) for i, v in enumerate("aabbba")], "id string, pos int, v string")
    assert {(r.v, r.first, r.last, r.n) for r in layout.merge_runs(rows, "id", "pos", "v").collect()} == {("a", 0, 1, 2), ("b", 2, 4, 3), ("a", 5, 5, 1)}
    frames = spark.createDataFrame([("v", float(t), d) for t, d in enumerate([0.0, 4.0, 6.0, 1.0] + [0.0] * 40)], "video_id string, t double, difference double")
    assert sorted(r.t for r in layout.key_frames(frames).collect()) == [0.0, 2.0, 34.0]


def test_stream_of_totals_is_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(s, n, f"2024-01-0{1 + n // 10}", rng.randint(0, 500)) for s in range(5) for n in range(30)]
    kind = "session_id long, seq long, local_day string, total long"
    for part in range(3):  # in the order of seq, split over batches, one batch twice
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    spark.createDataFrame([r for r in rows if r[1] // 10 == 1], kind).coalesce(1).write.parquet(f"{tmp_path}/in/3")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    days = reading.reading_days(spark, f"{tmp_path}/out")
    days.run(stream, f"{tmp_path}/marks")
    got = {(r.session_id, r.local_day): r.n for r in days.results().groupBy("session_id", "local_day").agg(F.sum("seconds").alias("n")).collect()}
    want = {}
    for s in range(5):
        most = 0
        for _, _, day, total in sorted(r for r in rows if r[0] == s):
            if total > most:
                want[s, day] = want.get((s, day), 0) + total - most
                most = total
    assert sum(got.values()) == sum(want.values())
    assert got == want
