"""Sources and forms over what the tables hold: their rows are written, or put together, as the
files, feeds, captions and pages that the readers take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import identity, layout, maintenance, pages, records, search, structure
from lectern.plans.registry import query
from lectern.plans.texts import _A, _B, _LOST
from lectern.sources import files
from lectern.sources.library import Library
from lectern.sources.shared import shared_path

#: Eight documents are a site, a feed or a page.
SITE = 8
BLANKS = r"regexp_replace({}, '[ \t\n\r\f\x0B]+', ' ', 'g')"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escaped(text: Column) -> Column:
    for sign, entity in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


@query(
    "plain_text",
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?i)<(br|/p|/div|/li|/h[1-6]|/tr)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM a)
    SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), concat(' ', chr(10))) AS text FROM b""",
)
def plain_text(lib: Library) -> DataFrame:
    return lib.pages.select("page_id", T.plain_text(F.col("html")).alias("text"))


@query("normalize_title", r"SELECT id, concat('ab1c2', regexp_replace(lower(nfc_normalize(title)), '[\s\p{P}\p{S}]+', '', 'g')) AS key FROM library_documents", ("library_documents",))
def normalize_title(lib: Library) -> DataFrame:
    """Titles after letters, a digit and a sign in their wide and ringed forms."""
    return lib.library_documents.select("id", T.normalize_title(F.concat(F.lit("Ａｂ①　Ｃ－２ "), "title")).alias("key"))


LINES = f"""l AS (SELECT id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS n FROM library_documents)"""


def events(lib: Library, event: Column) -> Column:
    return F.transform(F.split("body", "\n"), event)


@query(
    "read_caption_json3",
    f""", {LINES} SELECT id AS video_id, CAST(n * 1500 AS DOUBLE) / 1000 AS start, CAST(n % 7 * 250 AS DOUBLE) / 1000 AS duration, trim({BLANKS.format("concat(line, ' end')")}) AS text FROM l""",
    ("library_documents",),
)
def read_caption_json3(lib: Library) -> DataFrame:
    """Lines of documents as the events of a track, in two segments each."""
    event = lambda x, n: F.struct((n * 1500.0).alias("tStartMs"), (n % 7 * 250.0).alias("dDurationMs"), F.array(F.struct(x.alias("utf8")), F.struct(F.lit(" end").alias("utf8"))).alias("segs"))
    payload = F.to_json(F.struct(events(lib, event).alias("events")))
    return files.caption_json3(lib.library_documents.select(F.col("id").alias("video_id"), payload.alias("payload")))


@query(
    "read_caption_timedtext",
    f""", {LINES} SELECT id AS video_id, CASE WHEN n % 2 = 0 THEN n + 0.5 ELSE CAST(n AS DOUBLE) END AS start, CASE WHEN n % 2 = 0 THEN 2.0 ELSE 0.25 END AS duration, trim({BLANKS.format("line")}) AS text FROM l WHERE trim({BLANKS.format("line")}) <> ''""",
    ("library_documents",),
)
def read_caption_timedtext(lib: Library) -> DataFrame:
    """Lines of documents by turns in both forms of the XML."""
    even = lambda x, n: F.concat(F.lit('<text start="'), (n + 0.5).cast("string"), F.lit('" dur="2">'), escaped(x), F.lit("</text>"))
    odd = lambda x, n: F.concat(F.lit('<p t="'), (n * 1000).cast("string"), F.lit('" d="250">'), escaped(x), F.lit("</p>"))
    made = F.array_join(events(lib, lambda x, n: F.when(n % 2 == 0, even(x, n)).otherwise(odd(x, n))), "")
    return files.caption_timedtext(lib.library_documents.select(F.col("id").alias("video_id"), F.concat(F.lit("<transcript>"), made, F.lit("</transcript>")).alias("payload")))


@query(
    "read_atom_entries",
    f""", p AS (SELECT number, {BLANKS.format("replace(title, '<', ' ')")} AS title, {BLANKS.format("replace(body, '<', ' ')")} AS summary FROM library_papers)
    SELECT concat('http://papers.example/abs/', number) AS id, trim(title) AS title, substr(trim(summary), 1, 4000) AS summary, concat('2024-01-', CAST(10 + number % 10 AS VARCHAR)) AS published FROM p""",
    ("library_papers",),
)
def read_atom_entries(lib: Library) -> DataFrame:
    """Papers as the entries of feeds."""
    n = F.col("number").cast("string")
    clean = lambda c: F.replace(c, F.lit("<"), F.lit(" "))
    entry = F.concat(F.lit("<entry>\n<id>http://papers.example/abs/"), n, F.lit("v"), (F.col("number") % 3 + 1).cast("string"), F.lit("</id><title type='text'>"), clean("title"), F.lit("</title>\n<summary>"), clean("body"), F.lit("</summary><published>2024-01-"), (F.col("number") % 10 + 10).cast("string"), F.lit("</published></entry>"))
    feeds = lib.library_papers.groupBy(F.floor(F.col("number") / SITE).alias("feed")).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("payload"))
    return files.atom_entries(feeds)


@query(
    "abstract_page_metadata",
    """, p AS (SELECT number, replace(title, chr(34), chr(39)) AS title, replace(body, chr(34), chr(39)) AS body FROM library_papers WHERE title <> '')
    SELECT concat('https://papers.example/', number) AS url, title, substr(body, 1, 4000) AS abstract, concat('A', number, '; B ', number) AS authors, '2024/01/02' AS published FROM p""",
    ("library_papers",),
)
def abstract_page_metadata(lib: Library) -> DataFrame:
    """Papers as pages with citation metas; every page also says that it has a licence."""
    quoted = lambda c: F.replace(c, F.lit('"'), F.lit("'"))
    meta = lambda name, value: F.concat(F.lit(f'<meta name="citation_{name}" content="'), value, F.lit('">\n'))
    n = F.col("number").cast("string")
    html = F.concat(F.lit('<head><meta name="license" content="x">'), meta("title", quoted("title")), meta("author", F.concat(F.lit("A"), n)), meta("author", F.concat(F.lit("B "), n)), meta("abstract", quoted("body")), meta("date", F.lit("2024/01/02")), F.lit("</head>"))
    found = files.abstract_page_metadata(lib.library_papers.select(F.concat(F.lit("https://papers.example/"), n).alias("url"), html.alias("html")))
    return found.withColumn("authors", F.array_join("authors", "; "))


def sites(lib: Library) -> DataFrame:
    """site, sidebar, readme: a group and its documents, the last one linked twice; the readme
    links every document."""
    docs = lib.library_documents.select(F.floor(F.col("number") / SITE).cast("string").alias("site"), "number")
    listed = F.array_sort(F.collect_list("number"))
    name = lambda x: x.cast("string")
    item = lambda x: F.concat(F.lit("    * [Doc *"), name(x), F.lit('*](doc-'), name(x), F.lit('.md "t")'))
    readme = lambda x: F.concat(F.lit("see [Text "), name(x), F.lit("](doc-"), name(x), F.lit(".md), [x](y.html)"))
    made = docs.groupBy("site").agg(listed.alias("n"))
    even = F.filter("n", lambda x: x % 2 == 0)
    sidebar = F.concat(F.lit("# Book\n- **Group**\n"), F.array_join(F.transform(even, item), "\n"), F.lit("\n"), F.array_join(F.transform(F.slice(even, -1, 1), item), "\n"))
    return made.where(F.size(even) > 0).select("site", sidebar.alias("sidebar"), F.array_join(F.transform("n", readme), "\n").alias("readme"))


SITES = f"""s AS (SELECT CAST(number // {SITE} AS VARCHAR(20)) AS site, number FROM library_documents), e AS (SELECT site FROM s WHERE number % 2 = 0 GROUP BY site)"""


@query(
    "read_markdown_sidebar",
    f""", {SITES} SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY number) AS INTEGER) AS "order", 2 AS depth, 'Group' AS "group", concat('Doc *', number, '*') AS title, concat('doc-', number, '.md') AS href FROM s WHERE number % 2 = 0""",
    ("library_documents",),
)
def read_markdown_sidebar(lib: Library) -> DataFrame:
    return files.markdown_sidebar(sites(lib))


@query(
    "read_readme_chapters",
    f""", {SITES} SELECT site, concat('Text ', number) AS title, concat('doc-', number, '.md') AS href FROM s JOIN e USING (site) WHERE number % 2 = 1""",
    ("library_documents",),
)
def read_readme_chapters(lib: Library) -> DataFrame:
    made = sites(lib)
    return files.readme_chapters(made, files.markdown_sidebar(made).select("site", "href"))


@query(
    "read_markdown_table",
    f""", r AS (SELECT CAST(number // {SITE} AS VARCHAR(20)) AS page, concat('2024-01-', 10 + number % 10) AS day, CASE WHEN number % 3 = 0 THEN concat('Plain ', number) ELSE concat('T', number) END AS title, CASE WHEN number % 3 = 0 THEN '' ELSE concat('https://x.example/', number) END AS url FROM library_documents)
    SELECT page, day, title, url, substr(sha256(concat(day, '|', title, '|', url)), 1, 24) AS id FROM r""",
    ("library_documents",),
)
def read_markdown_table(lib: Library) -> DataFrame:
    n = F.col("number").cast("string")
    cell = F.when(F.col("number") % 3 == 0, F.concat(F.lit("Plain "), n)).otherwise(F.concat(F.lit("[T"), n, F.lit("](https://x.example/"), n, F.lit(")")))
    row = F.concat(F.lit("| 2024-01-"), (F.col("number") % 10 + 10).cast("string"), F.lit(" | "), cell, F.lit(" |"))
    rows = lib.library_documents.groupBy(F.floor(F.col("number") / SITE).cast("string").alias("page")).agg(F.array_join(F.collect_list(row), "\n").alias("rows"))
    text = F.concat(F.lit("# Page\n## Other\n| 2020-01-01 | no |\n## Log of days\n| day | title |\n|---|:-:|\n"), "rows", F.lit("\n## End\n| 2021-01-01 | no |"))
    return files.markdown_table(rows.select("page", text.alias("text")), "Log")


@query(
    "read_text_items",
    """SELECT CAST(doc_id AS VARCHAR(20)) AS doc, CAST(1 + doc_id % 4 AS INTEGER) AS page, doc_id % 600 + 0.5 AS x, CAST(doc_id % 800 AS DOUBLE) AS y, CASE WHEN doc_id % 2 = 0 THEN 10.0 ELSE 0.0 END AS width, 0.0 AS height, source AS str, 'item' AS kind FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, concat('{broken ', doc_id), 'rejected' FROM documents WHERE doc_id % 7 = 0""",
)
def read_text_items(lib: Library) -> DataFrame:
    """Documents as items in JSON lines, of which some have no place and some are broken."""
    n = F.col("doc_id")
    item = F.to_json(F.struct(n.cast("string").alias("doc"), (1 + n % 4).alias("page"), F.when(n % 5 != 0, n % 600 + 0.5).alias("x"), (n % 800).alias("y"), F.when(n % 2 == 0, 10.0).alias("width"), F.col("source").alias("str")))
    path = shared_path(lib.spark, "items")
    lib.documents.select(F.when(n % 7 == 0, F.concat(F.lit("{broken "), n.cast("string"))).otherwise(item).alias("value")).write.text(path)
    items, bad = files.read_text_items(lib.spark, path)
    rejected = bad.select(F.col("line").alias("str"), F.lit("rejected").alias("kind"))
    return items.withColumn("kind", F.lit("item")).unionByName(rejected, allowMissingColumns=True)


@query(
    "read_ocr_tsv",
    """WITH t AS (SELECT doc_id, regexp_extract(text, '[A-Za-z]+') AS word FROM documents) SELECT CAST(doc_id % 100 AS INTEGER) AS page_num, CAST(doc_id AS INTEGER) AS word_num, CAST(doc_id % 600 AS INTEGER) AS left, CAST(least(100, greatest(0, doc_id % 130 - 10)) AS DOUBLE) AS conf, word AS text FROM t WHERE word <> '' AND doc_id % 6 <> 0""",
)
def read_ocr_tsv(lib: Library) -> DataFrame:
    """The first word of each document as a row of an OCR table; every sixth row is a line's."""
    n, zero = F.col("doc_id"), F.lit(0)
    level = F.when(n % 6 == 0, 4).otherwise(5)
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    rows = lib.documents.select(level.alias("level"), (n % 100).alias("page_num"), zero.alias("block_num"), zero.alias("par_num"), zero.alias("line_num"), n.alias("word_num"), (n % 600).alias("left"), zero.alias("top"), zero.alias("width"), zero.alias("height"), (n % 130 - 10).alias("conf"), word.alias("text"))
    path = shared_path(lib.spark, "ocr")
    rows.write.option("sep", "\t").option("header", "true").option("emptyValue", "").csv(path)  # else "" in quotes, which are text here
    return files.read_ocr_tsv(lib.spark, path).select("page_num", "word_num", "left", "conf", "text")


@query(
    "extract_file_text",
    r"""SELECT concat(doc_id, CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' ELSE '.bin' END) AS name, CASE WHEN doc_id % 3 = 2 THEN 'unsupported' WHEN trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) = '' THEN 'empty' ELSE 'complete' END AS status,
       CASE WHEN doc_id % 3 = 2 THEN 0 ELSE length(trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))) END AS chars FROM documents""",
)
def extract_file_text(lib: Library) -> DataFrame:
    extension = F.when(F.col("doc_id") % 3 == 0, "txt").when(F.col("doc_id") % 3 == 1, "md").otherwise("bin")
    rows = lib.documents.select(F.concat_ws(".", F.col("doc_id").cast("string"), extension).alias("name"), extension.alias("extension"), F.encode("text", "utf-8").alias("content"))
    return files.extract_file_text(rows).select("name", "status", F.length("text").cast("long").alias("chars"))


@query(
    "note_plain_text",
    rf""", n AS (SELECT concat(target_id, '-', turn) AS id, trim({BLANKS.format("note_text")}) AS t FROM notes) SELECT id, concat(CASE WHEN t <> '' THEN concat(t, chr(10)) ELSE '' END, '[a picture]', chr(10), 'last ', id) AS text FROM n""",
    ("notes",),
)
def note_plain_text(lib: Library) -> DataFrame:
    name = F.concat_ws("-", "target_id", F.col("turn").cast("string"))
    html = F.concat(F.lit("<p>"), escaped(F.col("note_text")), F.lit('</p><img src="x" alt="a picture"><div><p>last <b>'), name, F.lit("</b></p></div>"))
    return structure.note_plain_text(lib.notes.select(name.alias("id"), html.alias("html")))


@query(
    "transcript_article",
    """SELECT conv_id AS video_id, string_agg(text, ' ' ORDER BY turn, text) AS text, count(*) AS segments FROM conversations GROUP BY conv_id""",
)
def transcript_article(lib: Library) -> DataFrame:
    return structure.transcript_article(lib.conversations.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("start"), "text")).select("video_id", "text", "segments")


@query(
    "repository_profile",
    """WITH f AS (SELECT p_brand AS repository, p_type, p_size, concat(replace(p_type, ' ', '/'), '/', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' ELSE '.md' END) AS path FROM part),
    c AS (SELECT repository, split_part(path, '/', 1) AS dir, count(*) AS n FROM f GROUP BY ALL),
    d AS (SELECT repository, dir, row_number() OVER (PARTITION BY repository ORDER BY n DESC, dir) AS k FROM c),
    g AS (SELECT repository, string_agg(dir, ',' ORDER BY k) AS dirs FROM d WHERE k <= 3 GROUP BY repository)
    SELECT repository, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS bytes, any_value(dirs) AS dirs,
           array_to_string(list_filter([CASE WHEN bool_or(path LIKE '%.py') THEN 'Python' END, CASE WHEN bool_or(path LIKE '%.rs') THEN 'Rust' END, CASE WHEN bool_or(path LIKE '%COPPER%') THEN 'Copper' END], lambda x: x IS NOT NULL), ',') AS stack
    FROM f JOIN g USING (repository) GROUP BY repository""",
)
def repository_profile(lib: Library) -> DataFrame:
    end = F.when(F.col("p_partkey") % 3 == 0, ".py").when(F.col("p_partkey") % 3 == 1, ".rs").otherwise(".md")
    rows = lib.part.select(F.col("p_brand").alias("repository"), F.concat(F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), F.col("p_partkey").cast("string"), end).alias("path"), F.col("p_size").cast("long").alias("bytes"))
    return structure.repository_profile(rows, [("Python", r"\.py$"), ("Rust", r"\.rs$"), ("Copper", "COPPER")], 3)


@query("sink_snapshot", "SELECT id, title, 2 AS number FROM library_documents WHERE number % 3 = 1", ("library_documents",))
def sink_snapshot(lib: Library) -> DataFrame:
    """Two versions are published; a third fails its check and changes nothing."""
    store = maintenance.Snapshots(lib.spark, shared_path(lib.spark, "snapshots"))
    for third, check in ((0, F.lit(True)), (1, F.col("id") != ""), (2, F.col("id") == "")):
        try:
            store.publish(lib.library_documents.where(F.col("number") % 3 == third).select("id", "title"), {"check": check})
        except ValueError:
            if third != 2:
                raise
    return store.read().withColumn("number", F.lit(store.number()).cast("int"))


@query(
    "page",
    """, p AS (SELECT id, row_number() OVER (ORDER BY updated_at DESC, number) AS place, count(*) OVER () AS total FROM library_documents) SELECT place, id, total, total > 500 AS has_more FROM p WHERE place > 300 AND place <= 500""",
    ("library_documents",),
)
def page(lib: Library) -> DataFrame:
    """A page of more rows than a page has, from far behind."""
    found = search.paged(lib.library_documents.select("id", "number", "updated_at"), [F.col("updated_at").desc(), F.col("number")], 1000, 300)
    return found.select("place", "id", "total", "has_more")


@query(
    "restore_figures",
    """, f AS (SELECT number, id, trim(regexp_replace(lower(title), '[ \\t\\n\\r]+', ' ', 'g')) AS key, title FROM library_documents WHERE title <> '')
    SELECT id AS page_id, title AS caption, CASE number % 3 WHEN 0 THEN concat('own-', id) WHEN 1 THEN concat('img-', id) END AS src FROM f""",
    ("library_documents",),
)
def restore_figures(lib: Library) -> DataFrame:
    """A figure of each document; a third has its image, another third's source has one."""
    docs = lib.library_documents.where("title <> ''")
    article = docs.select(F.col("id").alias("page_id"), F.col("title").alias("caption"), F.when(F.col("number") % 3 == 0, F.concat(F.lit("own-"), "id")).alias("src"))
    source = docs.where("number % 3 < 2").select(F.col("id").alias("page_id"), F.concat(F.lit("  "), F.lower("title")).alias("caption"), F.concat(F.when(F.col("number") % 3 == 0, "own-").otherwise("img-"), "id").alias("src"))
    return structure.restore_figures(article, source)


@query(
    "revalidate_structures",
    rf"""WITH p AS (SELECT page_id, html AS s, CASE WHEN page_id % 2 = 0 THEN html ELSE regexp_replace(html, '<(a|h2)[^>]*>', '', 'g') END AS t FROM pages WHERE page_id % 5 <> 0), c AS (SELECT page_id, {_A}, {_B} FROM p),
    m AS (SELECT page_id, array_to_string(list_filter([{_LOST}], lambda x: x IS NOT NULL), ',') AS missing FROM c)
    SELECT CAST(page_id AS VARCHAR(20)) AS id, 3 AS metric_version, missing, CASE WHEN missing = '' THEN 'complete' ELSE 'degraded' END AS fidelity FROM m""",
)
def revalidate_structures(lib: Library) -> DataFrame:
    """Metrics of an older version first, then those of today, then nothing to be done."""
    n = F.col("page_id")
    papers = lib.pages.select(n.cast("string").alias("id"), F.col("html").alias("source_html"), F.when(n % 2 == 0, F.col("html")).otherwise(F.regexp_replace("html", "<(a|h2)[^>]*>", "")).alias("translation_html"), F.when(n % 5 == 0, "open").otherwise("ready").alias("status"), F.lit("auto").alias("validation"))
    store = maintenance.Snapshots(lib.spark, shared_path(lib.spark, "metrics"))
    ids = papers.select("id")
    pages.revalidate_structures(store, papers, ids.where("CAST(id AS LONG) % 3 = 0"), version=2)
    for _ in range(2):
        pages.revalidate_structures(store, papers, ids)
    return store.read()


@query("backfill_identity", "SELECT id, CASE WHEN number % 4 = 0 THEN NULL ELSE concat('arxiv:2401.', lpad(CAST(number AS VARCHAR(9)), 5, '0')) END AS identity FROM library_papers WHERE number % 2 = 0", ("library_papers",))
def backfill_identity(lib: Library) -> DataFrame:
    """Odd papers have their identity already; every fourth has none at all."""
    from lectern.operators import library

    n = F.lpad(F.col("number").cast("string"), 5, "0")
    known = F.concat(F.lit("arxiv:2401."), n)
    stored = F.when(F.col("number") % 4 == 0, "doi:10.1000/old").when(F.col("number") % 2 == 1, known)
    url = F.when(F.col("number") % 4 == 0, F.lit("https://nothing.example/x")).otherwise(F.concat(F.lit("https://arxiv.org/pdf/2401."), n, F.lit("v3.pdf")))
    rows = lib.library_papers.select("id", url.alias("url"), stored.alias("identity"))
    return library.backfill(rows, "identity", identity.paper_record(F.col("url"))["identity"]).select("id", "identity")


@query(
    "split_oversize",
    """, l AS (SELECT id, n, CASE WHEN n % 9 = 4 THEN concat('[page ', n, ']') ELSE line END AS text FROM (SELECT id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS n FROM library_documents)),
    u AS (SELECT *, last_value(CASE WHEN regexp_matches(text, '^\\[page [0-9]+\\]$') THEN text END IGNORE NULLS) OVER o AS mark, CAST(sum(length(text) + 1) OVER o - 1 AS BIGINT) // 900 AS part FROM l WINDOW o AS (PARTITION BY id ORDER BY n)),
    p AS (SELECT id, part, arg_min(mark, n) FILTER (WHERE mark IS NOT NULL AND n = first) AS mark, string_agg(text, chr(10) ORDER BY n) AS text FROM (SELECT *, min(n) OVER (PARTITION BY id, part) AS first FROM u) GROUP BY id, part)
    SELECT id, part, CASE WHEN mark IS NOT NULL AND NOT starts_with(text, mark) THEN concat(mark, chr(10), text) ELSE text END AS text FROM p""",
    ("library_documents",),
)
def split_oversize(lib: Library) -> DataFrame:
    """Lines of documents, some of which are marks of pages."""
    lines = lib.library_documents.select("id", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    marked = F.when(F.col("pos") % 9 == 4, F.concat(F.lit("[page "), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.col("line"))
    return structure.split_oversize(lines.select("id", "pos", marked.alias("text")), 900)


@query(
    "markdown_to_article",
    r""", t AS (SELECT id, title, trim(regexp_replace(concat('Heading ', id, chr(10), 'a bold text and link', chr(10), ' ', chr(10), chr(10), 'item', chr(10), translate(body, '*_`~#[]()!+-', '')), '
{3,}', chr(10) || chr(10), 'g')) AS body FROM library_documents)
    SELECT id, title, body, length(body) AS chars FROM t WHERE length(body) >= 180""",
    ("library_documents",),
)
def markdown_to_article(lib: Library) -> DataFrame:
    """Documents without marks of their own, after a heading, a list and code."""
    clean = F.translate("body", "*_`~#[]()!+-", "")
    text = F.concat(F.lit("## Heading "), "id", F.lit("\na **bold** _text_ and [link](https://x.example)\n```py\nx = 1\n```\n\n- item\n"), clean)
    made = structure.markdown_to_article(lib.library_documents.select("id", "title", text.alias("text")))
    return made.select("id", "title", "body", F.length("body").cast("long").alias("chars"))


@query(
    "repair_table_spans",
    """WITH c AS (SELECT l_orderkey AS table_id, CAST(l_linenumber AS INTEGER) AS "row", CAST(l_partkey * 100 + l_suppkey AS BIGINT) AS col, CAST(min(l_quantity) - 10 AS INTEGER) AS span FROM lineitem GROUP BY ALL),
    n AS (SELECT *, count(*) OVER (PARTITION BY table_id, "row") AS cells FROM c), f AS (SELECT table_id, "row", lead(cells) OVER (PARTITION BY table_id ORDER BY "row") AS following FROM (SELECT DISTINCT table_id, "row", cells FROM n))
    SELECT table_id, "row", col, CAST(CASE WHEN cells = 1 AND following > 1 THEN least(following, 20) ELSE greatest(1, least(20, span)) END AS INTEGER) AS span FROM n JOIN f USING (table_id, "row")""",
)
def repair_table_spans(lib: Library) -> DataFrame:
    """Orders as tables, their lines' numbers as rows."""
    col = (F.col("l_partkey").cast("long") * 100 + F.col("l_suppkey")).alias("col")
    cells = lib.lineitem.groupBy(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").cast("int").alias("row"), col).agg((F.min("l_quantity") - 10).cast("int").alias("span"))
    return structure.repair_table_spans(cells)


@query(
    "embedded_images",
    """, t AS (SELECT number AS page_id, concat('picture of ', url) AS data FROM library_articles) SELECT page_id, 'png' AS kind, sha256(data) AS sha256, CAST(strlen(data) AS INTEGER) AS bytes FROM t""",
    ("library_articles",),
)
def embedded_images(lib: Library) -> DataFrame:
    """A picture in each page's html, beside one that is linked."""
    data = F.base64(F.encode(F.concat(F.lit("picture of "), "url"), "utf-8"))
    html = F.concat(F.lit('<img src="data:image/png;base64,'), F.regexp_replace(data, r"\s", ""), F.lit('"><img src="https://x.example/i.png">'), "html")
    return pages.embedded_images(lib.pages.select("page_id", html.alias("html")))


@query(
    "merge_images_by_position",
    """, l AS (SELECT id, unnest(string_split(body, chr(10))) AS text, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM library_documents), c AS (SELECT id, max(n) AS most FROM l GROUP BY id),
    r AS (SELECT id AS page_id, n, 1 AS after, text, CAST(NULL AS VARCHAR) AS src FROM l UNION ALL SELECT id, i, 0, CAST(NULL AS VARCHAR), concat('img-', i) FROM c, (VALUES (1), (3), (1000000)) t(i))
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n, after, src) AS INTEGER) AS pos, text, src FROM r""",
    ("library_documents",),
)
def merge_images_by_position(lib: Library) -> DataFrame:
    """Three images of each document: before its first and third lines, and after the last."""
    blocks = lib.library_documents.select(F.col("id").alias("page_id"), F.posexplode(F.split("body", "\n")).alias("pos", "text"))
    images = lib.library_documents.select(F.col("id").alias("page_id"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(1_000_000))).alias("n"))
    return structure.merge_images_by_position(images.withColumn("src", F.concat(F.lit("img-"), F.col("n").cast("string"))), blocks)


@query(
    "select_candidate",
    """, c AS (SELECT number // 4 AS week, id, number FROM library_documents WHERE number % 2 = 0), f AS (SELECT week, min(id) AS id FROM c WHERE week % 3 <> 0 GROUP BY week)
    SELECT week, id FROM f WHERE id NOT IN (SELECT id FROM library_documents WHERE number % 5 = 0)""",
    ("library_documents",),
)
def select_candidate(lib: Library) -> DataFrame:
    """Four documents a week, of which the even ones are chosen; every third week is done."""
    docs = lib.library_documents
    week = F.floor(F.col("number") / 4).alias("week")
    candidates = docs.select(week, "id", (F.col("number") % 2 == 0).alias("chosen"))
    status = docs.select(week, F.when(F.floor(F.col("number") / 4) % 3 == 0, "done").otherwise("open").alias("status")).distinct()
    return records.select_candidate(candidates, status, docs.where("number % 5 = 0")).select("week", "id")


@query(
    "key_frames",
    """, f AS (SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY ts, seq) AS n, value / 40 AS d FROM ticks),
    s AS (
      SELECT owner_id, n, 1 AS last, CAST(0 AS DOUBLE) AS gone, true AS kept, d FROM f WHERE n = 1
      UNION ALL
      SELECT owner_id, n, CASE WHEN keeps THEN n ELSE last END, CASE WHEN keeps THEN 0 ELSE more END, keeps, d
      FROM (SELECT f.owner_id, f.n, s.last, s.gone + f.d AS more, f.d, s.gone + f.d >= 9 OR f.n - s.last >= 8 AS keeps FROM s JOIN f ON f.owner_id = s.owner_id AND f.n = s.n + 1)
    )
    SELECT CAST(owner_id AS VARCHAR) AS video_id, CAST(n AS DOUBLE) AS t FROM s WHERE kept""",
    ("ticks",),
)
def key_frames(lib: Library) -> DataFrame:
    """An owner's ticks as frames a second apart, which differ by their values."""
    n = F.row_number().over(Window.partitionBy("owner_id").orderBy("ts", "seq"))
    frames = lib.ticks.select(F.col("owner_id").cast("string").alias("video_id"), n.cast("double").alias("t"), (F.col("value") / 40).alias("difference"))
    return layout.key_frames(frames, 9.0, 8.0).select("video_id", "t")
