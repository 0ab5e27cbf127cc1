"""Links, identities, embedded objects and small forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import hierarchy, identity, layout, library, links, pages, retrieval, sanitize, search, structure
from lectern.plans.registry import query
from lectern.plans.search import CITED, FOLD, HITS, WORD, WORDS, sources
from lectern.plans.texts import SPACED
from lectern.sources.library import Library

LINE = SPACED.format("body")


def variants(df: DataFrame, *forms: str) -> DataFrame:
    """A row for each row and form, the form as `form`."""
    return df.withColumn("form", F.explode(F.array(*map(F.lit, forms))))


@query(
    "resolve_links",
    r"""WITH h AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS href FROM pages),
    r AS (SELECT page_id, href, CASE WHEN href LIKE '/%' AND href NOT LIKE '//%' THEN concat(regexp_extract(url, '^(https?)://', 1), '://', lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), href) END AS link FROM h)
    SELECT page_id, href, link, regexp_replace(link, '^http://', 'https://') AS image FROM r""",
)
def resolve_links(lib: Library) -> DataFrame:
    """The links that the pages hold."""
    rows = pages.links(lib.pages).join(lib.pages.select("page_id", "url"), "page_id")
    return rows.select("page_id", "href", links.resolve_links(F.col("url"), F.col("href")).alias("link"), links.resolve_links(F.col("url"), F.col("href"), True).alias("image"))


@query(
    "normalize_images",
    """, v AS (SELECT number AS page_id, unnest([['late.png', NULL, 'x.gif', NULL, 'width: 320px'], [NULL, 'orig.png', 'x.gif', '640', NULL], [NULL, NULL, 'plain.png', '50%', 'max-width:9px'], [NULL, NULL, NULL, '0', 'color:red; WIDTH:12.5px']]) AS a FROM library_articles)
    SELECT page_id, coalesce(a[1], a[2], a[3]) AS source, CASE WHEN a[1] IS NOT NULL THEN 320 WHEN a[2] IS NOT NULL THEN 640 WHEN a[3] IS NULL THEN NULL END AS width, count(*) AS n FROM v GROUP BY ALL""",
    ("library_articles",),
)
def normalize_images(lib: Library) -> DataFrame:
    images = (("late.png", None, "x.gif", None, "width: 320px"), (None, "orig.png", "x.gif", "640", None), (None, None, "plain.png", "50%", "max-width:9px"), (None, None, None, "0", "color:red; WIDTH:12.5px"))
    rows = lib.library_articles.select(F.col("number").alias("page_id"), F.explode(F.array(*(F.struct(*(F.lit(x).cast("string").alias(f"a{i}") for i, x in enumerate(v))) for v in images))).alias("v")).select("page_id", "v.*")
    return rows.select("page_id", links.lazy_source(F.col("a0"), F.col("a1"), F.col("a2")).alias("source"), links.display_width(F.col("a3"), F.col("a4")).alias("width")).groupBy("page_id", "source", "width").agg(F.count("*").alias("n"))


@query(
    "embedded_json",
    """, p AS (SELECT number AS page_id, title, url FROM library_articles) SELECT page_id, url, CAST(page_id AS BIGINT) AS k, concat('"}', title, chr(92), '"{') AS inner FROM p""",
    ("library_articles",),
)
def embedded_json(lib: Library) -> DataFrame:
    """Each page's own data inside a script, with braces in its strings."""
    page = lib.library_articles.withColumn("title", F.concat(F.lit('"}'), "title", F.lit('\\"{')))
    made = F.concat(F.lit('<script>var other = {"x": 1}; var player = '), F.to_json(F.struct(F.concat(F.lit("}{ "), "url").alias("u"), F.struct(F.col("number").alias("k"), F.col("title").alias("t")).alias("o"))), F.lit('; call({"y": 2});</script>'), "body")
    found = page.select(F.col("number").alias("page_id"), links.embedded_json(made, "var player = ").alias("json"))
    return found.select("page_id", F.expr("substr(get_json_object(json, '$.u'), 4)").alias("url"), F.get_json_object("json", "$.o.k").cast("long").alias("k"), F.get_json_object("json", "$.o.t").alias("inner"))


DOCS_FORMS = ("https://github.com/own/lib.git/tree/main/docs/guide/", "https://site.example/book/#/part/one?id=x", "https://site.example/book/index.html", "https://site.example", "nothing")


@query(
    "docs_source_identity",
    f""", f AS (SELECT number, unnest([{", ".join(f"'{x}'" for x in DOCS_FORMS)}]) AS form FROM library_papers), s AS (SELECT number, replace(replace(form, 'site.', concat('s', CAST(number AS VARCHAR(9)), '.')), 'own/', concat('own', CAST(number AS VARCHAR(9)), '/')) AS url, form FROM f)
    SELECT url, CASE WHEN form LIKE '%github%' THEN 'repository' WHEN form <> 'nothing' THEN 'site' END AS kind,
           CASE WHEN form LIKE '%github%' THEN concat('https://raw.githubusercontent.com/own', CAST(number AS VARCHAR(9)), '/lib/main/docs/guide/') WHEN form = 'nothing' THEN NULL WHEN form LIKE '%book%' THEN concat('https://s', CAST(number AS VARCHAR(9)), '.example/book/') ELSE concat(url, '/') END AS base,
           CASE WHEN form LIKE '%github%' THEN '' WHEN form = 'nothing' THEN NULL WHEN form LIKE '%#%' THEN 'part/one' ELSE '' END AS route,
           CASE WHEN form LIKE '%github%' THEN 'lib' WHEN form = 'nothing' THEN NULL ELSE '' END AS repository FROM s""",
    ("library_papers",),
)
def docs_source_identity(lib: Library) -> DataFrame:
    number = F.col("number").cast("string")
    rows = variants(lib.library_papers, *DOCS_FORMS).select(F.replace(F.replace("form", F.lit("site."), F.concat(F.lit("s"), number, F.lit("."))), F.lit("own/"), F.concat(F.lit("own"), number, F.lit("/"))).alias("url"))
    found = rows.withColumn("d", links.docs_source(F.col("url")))
    return found.select("url", "d.kind", "d.base", "d.route", "d.repository")


@query(
    "match_chapter_heading",
    """, v AS (SELECT id, title, unnest([concat(title, ' （2/9）'), concat(translate(title, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '.'), concat(' ', title, ' (1 / 3) '), replace(title, ' ', '　'), '']) AS line FROM library_documents)
    SELECT id, line, regexp_replace(regexp_replace(translate(line, '（）／　', '()/ '), '\\s*\\([0-9]+\\s*/\\s*[0-9]+\\)\\s*$', ''), '\\s+', '', 'g') = regexp_replace(title, '\\s+', '', 'g') AND title <> '' AS matches
    FROM v WHERE NOT regexp_matches(title, '\\([0-9]+ */ *[0-9]+\\)\\s*$')""",
    ("library_documents",),
)
def match_chapter_heading(lib: Library) -> DataFrame:
    titles = lib.library_documents.where(r"NOT regexp_like(title, '\\([0-9]+ */ *[0-9]+\\)\\s*$')").select("id", "title")
    line = F.explode(F.array(F.concat("title", F.lit(" （2/9）")), F.concat(F.translate("title", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(".")), F.concat(F.lit(" "), "title", F.lit(" (1 / 3) ")), F.replace("title", F.lit(" "), F.lit("　")), F.lit("")))
    return titles.select("id", "title", line.alias("line")).select("id", "line", links.match_chapter_heading(F.col("line"), F.col("title")).alias("matches"))


@query(
    "preview_text",
    f""", b AS (SELECT id, pos, {SPACED.format("line")} AS line FROM (SELECT id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM library_documents UNION ALL SELECT id, concat('来源：', repeat('汉字', 50)), 1000000 FROM library_documents UNION ALL SELECT id, concat('文', repeat('汉字', 150 * CAST(number % 2 AS INTEGER))), 1000001 FROM library_documents)),
    r AS (SELECT id, line, row_number() OVER (PARTITION BY id ORDER BY NOT (length(line) >= 80 AND len(regexp_extract_all(line, '[㐀-鿿]')) >= 8 AND NOT regexp_matches(line, '(?i)^(作者|arxiv|来源|论文信息)[：:\\s]')), pos) AS k FROM b WHERE line <> '')
    SELECT id, CASE WHEN length(line) > 260 THEN concat(substr(line, 1, 260), '…') ELSE line END AS preview FROM r WHERE k = 1""",
    ("library_documents",),
)
def preview_text(lib: Library) -> DataFrame:
    docs = lib.library_documents
    blocks = docs.select("id", F.posexplode(F.split("body", "\n")).alias("pos", "text"))
    source = docs.select("id", F.lit(1_000_000).alias("pos"), F.concat(F.lit("来源："), F.repeat(F.lit("汉字"), F.lit(50))).alias("text"))
    prose = docs.select("id", F.lit(1_000_001).alias("pos"), F.concat(F.lit("文"), F.repeat(F.lit("汉字"), (F.col("number") % 2 * 150).cast("int"))).alias("text"))
    return links.preview_text(blocks.unionByName(source).unionByName(prose))


@query(
    "last_message_per_role",
    "SELECT conversation_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_question, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_answer, count(*) AS messages FROM messages GROUP BY conversation_id",
    ("messages",),
)
def last_message_per_role(lib: Library) -> DataFrame:
    return links.last_message_per_role(lib.messages)


@query(
    "manifest_verify",
    """, f AS (SELECT concat('docs/', id) AS path, number, sha256(coalesce(body, '')) AS own, octet_length(encode(coalesce(body, ''))) AS size FROM library_documents)
    SELECT path, CASE number % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'changed' ELSE 'ok' END AS state FROM f UNION ALL SELECT concat('../', path), 'outside' FROM f""",
    ("library_documents",),
)
def manifest_verify(lib: Library) -> DataFrame:
    """A quarter of the files is missing, another has one byte more than the manifest says."""
    docs = lib.library_documents.select(F.concat(F.lit("docs/"), "id").alias("path"), "number", F.coalesce("body", F.lit("")).alias("body"))
    manifest = docs.select("path", F.sha2("body", 256).alias("sha256"), F.octet_length("body").cast("long").alias("bytes"))
    manifest = manifest.unionByName(manifest.withColumn("path", F.concat(F.lit("../"), "path")))
    files = docs.where("number % 4 <> 0").select("path", F.concat("body", F.when(F.col("number") % 4 == 1, "x").otherwise("")).cast("binary").alias("content"))
    return links.manifest_verify(manifest, files)


@query(
    "latest_digests",
    """, d AS (SELECT target_id, turn, updated_at, length(note_text) AS size FROM notes) SELECT concat(target_id, '-', CAST(turn AS VARCHAR(9))) AS id, CASE WHEN size % 5 = 0 THEN NULL ELSE size END AS notes FROM d ORDER BY updated_at DESC, concat(target_id, '-', CAST(turn AS VARCHAR(9))) DESC LIMIT 100""",
    ("notes",),
)
def latest_digests(lib: Library) -> DataFrame:
    size = F.length("note_text")
    made = F.when(size % 5 == 0, "{broken").otherwise(F.to_json(F.struct(size.alias("notes"))))
    digests = lib.notes.select(F.concat("target_id", F.lit("-"), F.col("turn").cast("string")).alias("id"), F.col("updated_at").alias("created_at"), made.alias("digest_json"))
    return links.latest_digests(digests, "notes long", 1000).select("id", F.col("digest.notes").alias("notes"))


@query(
    "search_excerpt_180",
    f""", l AS (SELECT id, {LINE} AS line FROM library_documents), s AS (SELECT id, line, greatest(0, strpos(lower(line), '{WORD}') - 56) AS start FROM l)
    SELECT id, concat(CASE WHEN start > 0 THEN '…' ELSE '' END, substr(line, start + 1, 180), CASE WHEN start + 180 < length(line) THEN '…' ELSE '' END) AS excerpt FROM s""",
    ("library_documents",),
)
def search_excerpt_180(lib: Library) -> DataFrame:
    return lib.library_documents.select("id", links.search_excerpt(F.col("body"), WORD.title()).alias("excerpt"))


@query(
    "union_distinct_hits",
    f""", {HITS}, again AS (SELECT target_type, target_id FROM hits UNION SELECT target_type, target_id FROM content_tags UNION SELECT target_type, target_id FROM content WHERE contains({FOLD.format("title")}, '{WORDS}'))
    SELECT target_type, target_id FROM again""",
    ("content", "content_tags"),
)
def union_distinct_hits(lib: Library) -> DataFrame:
    found = [search.hits_in(items, kind, fields, WORDS) for items, kind, fields in sources(lib)]
    return links.distinct_hits(*found, lib.content_tags, lib.content.where(T.literal_contains(F.col("title"), WORDS)))


@query("union_all_content", "SELECT target_type, target_id, title, category, summary, CAST(updated_at AS VARCHAR) AS updated_at FROM content", ("content",))
def union_all_content(lib: Library) -> DataFrame:
    return lib.content.select("target_type", "target_id", "title", "category", "summary", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query(
    "paper_identity",
    """, v AS (SELECT id, lpad(CAST(number AS VARCHAR(9)), 5, '0') AS n FROM library_papers)
    SELECT id, unnest([concat('arxiv:2401.', n), concat('arxiv:2401.', n), concat('doi:10.1000/x', n), NULL]) AS identity, unnest([1, 2, 3, 4]) AS form FROM v""",
    ("library_papers",),
)
def paper_identity(lib: Library) -> DataFrame:
    n = F.lpad(F.col("number").cast("string"), 5, "0")
    forms = F.posexplode(F.array(F.concat(F.lit("https://arxiv.org/abs/2401."), n, F.lit("v2")), F.concat(F.lit("see arXiv:2401."), n), F.concat(F.lit("https://doi.org/10.1000/X"), n, F.lit(").")), F.concat(F.lit("no "), n)))
    return lib.library_papers.select("id", forms.alias("pos", "text")).select("id", identity.paper_identity(F.col("text")).alias("identity"), (F.col("pos") + 1).alias("form"))


@query(
    "paper_record",
    """, v AS (SELECT id, lpad(CAST(number AS VARCHAR(9)), 5, '0') AS n, number % 3 + 1 AS k FROM library_papers), f AS (
      SELECT id, 1 AS form, concat('arxiv:2401.', n) AS identity, concat('v', k) AS version, concat('https://arxiv.org/abs/2401.', n) AS canonical_url, concat('https://arxiv.org/abs/2401.', n, 'v', k) AS source_url, concat('https://arxiv.org/pdf/2401.', n, 'v', k) AS pdf_url FROM v
      UNION ALL SELECT id, 2, concat('arxiv:2401.', n), '', concat('https://arxiv.org/abs/2401.', n), concat('https://arxiv.org/abs/2401.', n), concat('https://arxiv.org/pdf/2401.', n) FROM v
      UNION ALL SELECT id, 3, concat('doi:10.1000/x', n, 'v', k), NULL, concat('https://doi.org/10.1000/x', n, 'v', k), NULL, NULL FROM v
      UNION ALL SELECT id, 4, NULL, NULL, NULL, NULL, NULL FROM v)
    SELECT * FROM f""",
    ("library_papers",),
)
def paper_record(lib: Library) -> DataFrame:
    n, k = F.lpad(F.col("number").cast("string"), 5, "0"), (F.col("number") % 3 + 1).cast("string")
    forms = F.posexplode(F.array(F.concat(F.lit("https://arxiv.org/pdf/2401."), n, F.lit("v"), k, F.lit(".pdf")), F.concat(F.lit("arXiv: 2401."), n), F.concat(F.lit("https://dx.doi.org/10.1000/X"), n, F.lit("v"), k, F.lit("?a=1")), F.concat(F.lit("https://evil.example/abs/2401."), n)))
    rows = lib.library_papers.select("id", forms.alias("pos", "text")).withColumn("r", identity.paper_record(F.col("text")))
    return rows.select("id", (F.col("pos") + 1).alias("form"), "r.identity", "r.version", "r.canonical_url", "r.source_url", "r.pdf_url")


@query(
    "video_identity",
    """, v AS (SELECT id, lpad(CAST(number AS VARCHAR(9)), 11, 'a') AS n FROM library_papers) SELECT id, unnest([concat('youtube:', n), concat('youtube:', n), concat('youtube:', n), concat('bilibili:BV', substr(n, 2)), NULL]) AS identity, unnest([1, 2, 3, 4, 5]) AS form FROM v""",
    ("library_papers",),
)
def video_identity(lib: Library) -> DataFrame:
    n = F.lpad(F.col("number").cast("string"), 11, "a")
    forms = F.posexplode(F.array(F.concat(F.lit("https://youtu.be/"), n, F.lit("?t=3")), F.concat(F.lit("https://www.youtube.com/watch?list=x&v="), n), F.concat(F.lit("https://www.youtube.com/shorts/"), n), F.concat(F.lit("https://www.bilibili.com/video/BV"), F.substring(n, 2, 10), F.lit("/?p=2")), F.concat(F.lit("https://v.example/"), n)))
    return lib.library_papers.select("id", forms.alias("pos", "url")).select("id", identity.video_identity(F.col("url")).alias("identity"), (F.col("pos") + 1).alias("form"))


@query("repository_identity", """, v AS (SELECT CAST(number AS VARCHAR(9)) AS n, id FROM library_documents) SELECT id, unnest([concat('own', n, '/lib.x'), concat('own', n, '/lib'), NULL]) AS identity, unnest([1, 2, 3]) AS form FROM v""", ("library_documents",))
def repository_identity(lib: Library) -> DataFrame:
    n = F.col("number").cast("string")
    forms = F.posexplode(F.array(F.concat(F.lit("https://github.com/own"), n, F.lit("/lib.x.git")), F.concat(F.lit("www.github.com/own"), n, F.lit("/lib/tree/main")), F.concat(F.lit("https://x.example/own"), n, F.lit("/lib"))))
    return lib.library_documents.select("id", forms.alias("pos", "url")).select("id", identity.repository_identity(F.col("url")).alias("identity"), (F.col("pos") + 1).alias("form"))


LINK_FORMS = ("./a/b.md?x#y", "/c.md", "../d.md", "https://x.example/e.md", "#f", "")


@query(
    "resolve_chapter_link",
    f""", f AS (SELECT url, unnest([{", ".join(f"'{x}'" for x in LINK_FORMS)}]) AS form FROM library_articles) SELECT url, form, CASE form WHEN './a/b.md?x#y' THEN concat(rtrim(url, '/'), '/a/b.md') WHEN '/c.md' THEN concat(rtrim(url, '/'), '/c.md') END AS link FROM f""",
    ("library_articles",),
)
def resolve_chapter_link(lib: Library) -> DataFrame:
    return variants(lib.library_articles.select("url"), *LINK_FORMS).select("url", "form", structure.resolve_chapter_link(F.col("url"), F.col("form")).alias("link"))


@query("recommend_folder", "SELECT id, CASE WHEN contains(lower(concat(title, ' ', category)), 'tion') THEN 'A' WHEN contains(lower(concat(title, ' ', category)), 'src1') THEN 'B' ELSE 'Other' END AS folder FROM library_documents", ("library_documents",))
def recommend_folder(lib: Library) -> DataFrame:
    return lib.library_documents.select("id", structure.recommend_folder(F.col("title"), F.col("category"), [("tion", "A"), ("src1", "B")], "Other").alias("folder"))


@query("clamp", "SELECT seq, greatest(1, least(50, coalesce(CAST(floor(TRY_CAST(CASE WHEN seq % 3 = 0 THEN 'x' ELSE CAST(value AS VARCHAR) END AS DOUBLE)) AS BIGINT), 7))) AS size FROM ticks", ("ticks",))
def clamp(lib: Library) -> DataFrame:
    return lib.ticks.select("seq", T.clamp(F.when(F.col("seq") % 3 == 0, "x").otherwise(F.col("value").cast("string")), 1, 50, 7).alias("size"))


@query(
    "prose_language_gate",
    r""", t AS (SELECT id, concat(repeat('汉', CAST(number % 90 AS INTEGER)), body) AS t FROM library_documents) SELECT id, len(regexp_extract_all(t, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]')) >= 40 AND len(regexp_extract_all(t, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]')) >= 0.7 * len(regexp_extract_all(t, '[A-Za-z]{2,}')) AS prose FROM t""",
    ("library_documents",),
)
def prose_language_gate(lib: Library) -> DataFrame:
    text = F.concat(F.repeat(F.lit("汉"), (F.col("number") % 90).cast("int")), F.col("body"))
    return lib.library_documents.select("id", library.prose_language_gate(text).alias("prose"))


@query("translation_need", "SELECT id, CASE WHEN lang IN ('en', 'mixed') THEN 'not_requested' ELSE 'not_required' END AS need FROM library_documents", ("library_documents",))
def translation_need(lib: Library) -> DataFrame:
    return lib.library_documents.select("id", library.translation_need(F.col("lang")).alias("need"))


@query("collection_counts", ", n AS (SELECT f.id, count(c.target_id) AS members FROM folders f LEFT JOIN content_folders c ON c.folder_id = f.id GROUP BY f.id) SELECT id, members FROM n", ("folders", "content_folders"))
def collection_counts(lib: Library) -> DataFrame:
    placed = lib.content_folders.select(F.col("folder_id").alias("id"))
    return library.counts_with_zeros(lib.folders.select("id"), placed, "id").toDF("id", "members")


@query(
    "folder_cycles",
    """, looped AS (SELECT id, CASE WHEN id = 'r1' THEN (SELECT min(id) FROM folders WHERE parent_id = 'r1') ELSE parent_id END AS parent_id FROM folders),
    up AS (SELECT id, parent_id AS above, 1 AS n FROM looped WHERE parent_id IS NOT NULL UNION ALL SELECT u.id, l.parent_id, n + 1 FROM up u JOIN looped l ON l.id = u.above WHERE l.parent_id IS NOT NULL AND n < 10)
    SELECT DISTINCT id FROM up WHERE above = id""",
    ("folders",),
)
def folder_cycles(lib: Library) -> DataFrame:
    """A root that is moved below its own child."""
    child = lib.folders.where("parent_id = 'r1'").agg(F.min("id").alias("child"))
    moved = lib.folders.join(F.broadcast(child)).withColumn("parent_id", F.when(F.col("id") == "r1", F.col("child")).otherwise(F.col("parent_id"))).drop("child")
    return hierarchy.folder_cycles(moved)


@query(
    "segments_in_window",
    """, s AS (SELECT conversation_id AS video_id, turn * 20 AS s, turn * 20 + 15 AS e, text FROM messages), w AS (SELECT video_id, lo, lo + 45 AS hi FROM (SELECT DISTINCT video_id FROM s), (VALUES (0), (50), (100)) v(lo))
    SELECT video_id, lo, hi, string_agg(text, ' ' ORDER BY s) AS text FROM w JOIN s USING (video_id) WHERE e >= lo AND s < hi GROUP BY ALL""",
    ("messages",),
)
def segments_in_window(lib: Library) -> DataFrame:
    start = F.col("turn") * 20
    segments = lib.messages.select(F.col("conversation_id").alias("video_id"), start.alias("start"), (start + 15).alias("end"), "text")
    windows = segments.select("video_id").distinct().withColumn("w_start", F.explode(F.array(*map(F.lit, (0, 50, 100))))).withColumn("w_end", F.col("w_start") + 45)
    return layout.segments_in_window(windows, segments).select("video_id", F.col("w_start").alias("lo"), F.col("w_end").alias("hi"), "text")


@query("dedup_consecutive_captions", ", s AS (SELECT conversation_id AS video_id, turn, role AS text, lag(role) OVER (PARTITION BY conversation_id ORDER BY turn) AS last FROM messages) SELECT video_id, turn, text FROM s WHERE last IS DISTINCT FROM text", ("messages",))
def dedup_consecutive_captions(lib: Library) -> DataFrame:
    segments = lib.messages.select(F.col("conversation_id").alias("video_id"), F.col("turn").alias("start"), F.col("role").alias("text"))
    return layout.dedup_consecutive_captions(segments).select("video_id", F.col("start").alias("turn"), "text")


@query(
    "toc_lines",
    r""", l AS (SELECT id, number, unnest(string_split(body, chr(10))) AS line FROM library_documents), v AS (SELECT id, substr(line, 1, 60) AS title, concat(substr(line, 1, 60), ' ..... ', CAST(number % 900 + 1 AS VARCHAR)) AS line, number % 900 + 1 AS page FROM l WHERE regexp_matches(substr(line, 1, 60), '^[A-Za-z][A-Za-z ]+[A-Za-z]$'))
    SELECT id, title, CAST(page AS INTEGER) AS page FROM v""",
    ("library_documents",),
)
def toc_lines(lib: Library) -> DataFrame:
    lines = lib.library_documents.select("id", "number", F.explode(F.split("body", "\n")).alias("line")).select("id", "number", F.substring("line", 1, 60).alias("line")).where(r"regexp_like(line, '^[A-Za-z][A-Za-z ]+[A-Za-z]$')")
    dotted = lines.select("id", layout.toc_line(F.concat("line", F.lit(" ..... "), (F.col("number") % 900 + 1).cast("string"))).alias("t"))
    return dotted.select("id", "t.title", "t.page")


@query(
    "validate_citations",
    f""", {CITED}, text_of AS (SELECT concat(id, '-C1') AS chunk_id, substr(body, 1, 1200) AS text FROM library_papers), v AS (SELECT * FROM cited UNION ALL SELECT answer_id, chunk_id, 'forged words that nobody wrote' FROM cited UNION ALL SELECT answer_id, 'none-C9', quote FROM cited UNION ALL SELECT answer_id, chunk_id, 'tiny' FROM cited)
    SELECT answer_id, v.chunk_id, quote FROM v JOIN text_of USING (chunk_id) WHERE length(trim(regexp_replace(quote, '[ \t\n\r]+', ' ', 'g'))) >= 6 AND contains(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), trim(regexp_replace(quote, '[ \t\n\r]+', ' ', 'g')))""",
    ("library_papers",),
)
def validate_citations(lib: Library) -> DataFrame:
    own = lib.library_papers.select(F.col("id").alias("answer_id"), F.concat("id", F.lit("-C1")).alias("chunk_id"), F.substring("body", 1, 30).alias("quote"))
    said = own.unionByName(own.withColumn("quote", F.lit("forged words that nobody wrote"))).unionByName(own.withColumn("chunk_id", F.lit("none-C9"))).unionByName(own.withColumn("quote", F.lit("tiny")))
    return retrieval.citation_join(said, retrieval.chunk_fixed(lib.library_papers))


@query(
    "article_videos",
    """, p AS (SELECT number AS page_id, lpad(CAST(number AS VARCHAR(9)), 11, 'v') AS v, title FROM library_articles)
    SELECT page_id, CAST(1 AS INTEGER) AS place, v AS video, 'a paragraph of text' AS anchor FROM p UNION ALL SELECT page_id, 2, concat('w', substr(v, 2)), CASE WHEN length(trim(title)) >= 8 THEN substr(trim(title), 1, 300) ELSE '' END FROM p""",
    ("library_articles",),
)
def article_videos(lib: Library) -> DataFrame:
    v = F.lpad(F.col("number").cast("string"), 11, "v")
    block = lambda pos, src, text: F.struct(F.lit(pos).alias("pos"), src.cast("string").alias("src"), text.cast("string").alias("text"))
    of = lambda host, v: F.concat(F.lit(f"https://{host}/embed/"), v)
    none = F.lit(None)
    made = F.array(
        block(1, of("www.youtube.com", v), none), block(2, none, F.lit("short")), block(3, none, F.lit(" a paragraph of text ")), block(4, of("youtube-nocookie.com", v), none), block(5, of("evil.example", v), none),
        block(6, F.concat(of("youtube.com", F.concat(F.lit("w"), F.substring(v, 2, 10))), F.lit("?rel=0")), none), block(7, none, F.col("title")),
    )
    blocks = lib.library_articles.select(F.col("number").alias("page_id"), F.explode(made).alias("b")).select("page_id", "b.*")
    return links.article_videos(blocks)


@query(
    "drop_empty_lists",
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1)) AS list, generate_subscripts(regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1), 1) AS n FROM pages),
    i AS (SELECT page_id, n, unnest(regexp_extract_all(list, '(?s)<li>(.*?)</li>', 1)) AS item, generate_subscripts(regexp_extract_all(list, '(?s)<li>(.*?)</li>', 1), 1) AS k FROM l),
    t AS (SELECT page_id, n, k FROM i WHERE k % 3 <> 0 AND trim(regexp_replace(item, '<[^>]*>', '', 'g')) <> '')
    SELECT page_id, CAST(1000 * n + k AS INTEGER) AS pos FROM t UNION ALL SELECT DISTINCT page_id, CAST(1000 * n AS INTEGER) FROM t""",
)
def drop_empty_lists(lib: Library) -> DataFrame:
    """The lists of the pages, of which every third item has lost its text."""
    lists = lib.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<ul>(.*?)</ul>"), F.lit(1))).alias("n", "list"))
    items = lists.select("page_id", "n", F.posexplode(F.regexp_extract_all("list", F.lit("(?s)<li>(.*?)</li>"), F.lit(1))).alias("k", "item"))
    holder = (1000 * (F.col("n") + 1)).cast("int")
    text = F.when((F.col("k") + 1) % 3 != 0, F.regexp_replace("item", "<[^>]*>", "")).otherwise(" ")
    own = items.select("page_id", (holder + F.col("k") + 1).cast("int").alias("pos"), F.lit("li").alias("kind"), holder.alias("holder"), text.alias("text"))
    heads = lists.select("page_id", holder.alias("pos"), F.lit("ul").alias("kind"), F.lit(None).cast("int").alias("holder"), F.lit(None).cast("string").alias("text"))
    return links.drop_empty_lists(own.unionByName(heads)).select("page_id", "pos")


@query("drop_decorative_images", """SELECT number AS page_id, unnest([1, 2, 5, 6]) AS pos FROM library_articles""", ("library_articles",))
def drop_decorative_images(lib: Library) -> DataFrame:
    block = lambda pos, kind, holder, text: F.struct(F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), F.lit(holder).cast("int").alias("holder"), F.lit(text).cast("string").alias("text"))
    made = F.array(block(1, "figure", None, None), block(2, "img", 1, None), block(3, "div", None, ""), block(4, "img", 3, " "), block(5, "p", None, "text"), block(6, "img", 5, "shown"), block(7, "img", 5, None))
    blocks = lib.library_articles.select(F.col("number").alias("page_id"), F.explode(made).alias("b")).select("page_id", "b.*")
    return links.drop_decorative_images(blocks).select("page_id", "pos")


@query(
    "sanitize_note_html",
    """, n AS (SELECT target_id, turn, replace(replace(replace(note_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM notes)
    SELECT target_id, turn, concat('<p style="color: red">', t, '<b>', t, '</b></p>[图片已移除]', t, '<a href="https://x.example/?a=1&amp;b" target="_blank" rel="noopener noreferrer">l</a><a>j</a><td width="4000">c</td>') AS html FROM n""",
    ("notes",),
)
def sanitize_note_html(lib: Library) -> DataFrame:
    text = F.replace(F.replace(F.replace("note_text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = ('<p onclick="x()" style="color: red; background: url(x); position:fixed">', text, "<script>if (a < b) bad()</script><b>", text, '</b></p><img src="http://x.example/i.png" onerror="x()"><custom-tag>', text, '</custom-tag><iframe src="x"><p>no</p></iframe><a href="https://x.example/?a=1&amp;b">l</a><a href=" javascript:x">j</a><td width="9999" colspan="-1">c</td></i>')
    made = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return lib.notes.select("target_id", "turn", sanitize.sanitize_note_html(made).alias("html"))


@query(
    "sanitize_word_html",
    """, n AS (SELECT target_id, turn, replace(replace(replace(note_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM notes)
    SELECT target_id, turn, concat('<p data-align="', CASE WHEN turn % 2 = 0 THEN 'center' ELSE 'right' END, '" data-indent="', 1 + turn % 3, '">', t, '</p><h2 data-indent="4">', t, t, '</h2><a href="https://x.example/">l</a>') AS html FROM n""",
    ("notes",),
)
def sanitize_word_html(lib: Library) -> DataFrame:
    """Notes as a paragraph, aligned by turns, and a heading around a table."""
    text = F.replace(F.replace(F.replace("note_text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    align = F.when(F.col("turn") % 2 == 0, "CENTER").otherwise("right")
    parts = ('<p class="x" style="text-align: ', align, "; margin-left: ", (40 * (1 + F.col("turn") % 3)).cast("string"), 'px">', text, '</p><script>x</script><h2 data-indent="9"><table><tr><td><b>', text, "</b></td></tr></table><custom>", text, '</custom></h2><a href="https://x.example/" onclick="y()">l</a>')
    made = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return lib.notes.select("target_id", "turn", sanitize.sanitize_word_html(made).alias("html"))
