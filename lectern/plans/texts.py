"""Text functions over whole tables, and the structure of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import pages
from lectern.plans.registry import query
from lectern.sources.library import Library

LINE = r"trim(regexp_replace({}, '[\s\x0B\x{{00a0}}\x{{feff}}\x{{2000}}-\x{{200a}}\x{{3000}}]+', ' ', 'g'))"


@query("make_summary", f"SELECT id, CASE WHEN {LINE.format('body')} = '' THEN '' WHEN length({LINE.format('body')}) > 220 THEN concat(substr({LINE.format('body')}, 1, 220), '…') ELSE {LINE.format('body')} END AS summary FROM library_documents", ("library_documents",))
def make_summary(lib: Library) -> DataFrame:
    return lib.library_documents.select("id", T.summary(F.col("body")).alias("summary"))


@query("clean_text", r"""SELECT id, sha256(trim(regexp_replace(regexp_replace(replace(body, chr(13), ''), '[ \t]+\n', chr(10), 'g'), '\n{3,}', concat(chr(10), chr(10)), 'g'))) AS digest FROM library_documents""", ("library_documents",))
def clean_text(lib: Library) -> DataFrame:
    return lib.library_documents.select("id", F.sha2(T.clean_text(F.col("body")), 256).alias("digest"))


#: Counts of a text t, and the language that they tell.
COUNTED = r"""len(regexp_extract_all(t, '[\x{3400}-\x{9fff}]')) AS han, len(regexp_extract_all(t, '[A-Za-z][A-Za-z''’-]+')) AS words, len(regexp_extract_all(t, '[A-Za-z]')) AS letters, greatest(length(replace(t, ' ', '')), 1) AS visible"""
SCRIPT = """CASE WHEN han >= 80 AND han / visible >= 0.08 THEN CASE WHEN words >= 120 AND han / visible < 0.22 AND letters > han * 1.35 THEN 'mixed' ELSE 'zh' END
  WHEN words >= 40 AND han / visible < 0.03 THEN 'en' WHEN han >= 20 AND words >= 40 THEN 'mixed' WHEN han > words THEN 'zh' WHEN words > 0 THEN 'en' ELSE 'unknown' END"""
SPACED = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x0B\x{{a0}}\x{{feff}}\x{{2000}}-\x{{200a}}\x{{3000}}]+', ' ', 'g'))"


@query(
    "detect_language",
    f""", l AS (SELECT lang, {SPACED.format("body")} AS t FROM (SELECT lang, body FROM library_documents UNION ALL SELECT 'han', repeat(concat('数据', substr(body, 1, 40)), 45) FROM library_documents)), c AS (SELECT lang, {COUNTED} FROM l)
    SELECT lang, {SCRIPT} AS script, count(*) AS items FROM c GROUP BY ALL""",
    ("library_documents",),
)
def detect_language(lib: Library) -> DataFrame:
    plain = lib.library_documents.select("lang", "body")
    han = plain.select(F.lit("han").alias("lang"), F.repeat(F.concat(F.lit("数据"), F.substring("body", 1, 40)), F.lit(45)).alias("body"))
    return plain.unionByName(han).select("lang", T.detect_language(F.col("body")).alias("script")).groupBy("lang", "script").agg(F.count("*").alias("items"))


@query("word_count", f"SELECT id, greatest(CASE WHEN {LINE.format('body')} = '' THEN 0 ELSE len(string_split({LINE.format('body')}, ' ')) END, len(regexp_extract_all(body, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]'))) AS words FROM library_documents", ("library_documents",))
def word_count(lib: Library) -> DataFrame:
    return lib.library_documents.select("id", T.word_count(F.col("body")).alias("words"))


@query(
    "text_layer_corruption",
    r""", w AS (SELECT id, m, regexp_replace(concat(coalesce(body, ''), repeat(chr(m), 1 + CAST(number % 60 AS INTEGER))), '[\s\x0B\x{a0}\x{feff}\x{2000}-\x{200a}\x{3000}]+', '', 'g') AS t FROM library_documents, (VALUES (65533), (7), (57345), (120)) v(m)),
    c AS (SELECT id, m, length(t) AS n, len(regexp_extract_all(t, '[\x00-\x08\x0E-\x1F\x7F-\x{9F}]')) AS control, len(regexp_extract_all(t, '[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]')) AS private, len(regexp_extract_all(t, '\x{FFFD}')) AS replaced,
            len(regexp_extract_all(t, '[\x{3400}-\x{4DBF}\x{0530}-\x{058F}\x{10A0}-\x{10FF}\x{1200}-\x{137F}\x{2D30}-\x{2D7F}\x{2F00}-\x{2FDF}]')) AS rare FROM w)
    SELECT id, CAST(m AS INTEGER) AS mark, n >= 80 AND (replaced >= 3 OR (control >= 8 AND control / n >= 0.005) OR (private >= 50 AND private / n >= 0.03)
           OR (control + private + replaced >= 24 AND (control + private + replaced) / n >= 0.012 AND rare >= 80 AND rare / n >= 0.08)) AS broken FROM c""",
    ("library_documents",),
)
def text_layer_corruption(lib: Library) -> DataFrame:
    """Texts as they are and with a tail of characters that don't belong there."""
    tail = lambda m: F.repeat(F.lit(chr(m)), (F.col("number") % 60 + 1).cast("int"))
    rows = lib.library_documents.select("id", F.explode(F.array(*(F.struct(F.lit(m).alias("mark"), F.concat(F.coalesce("body", F.lit("")), tail(m)).alias("text")) for m in (0xFFFD, 7, 0xE001, 120)))).alias("x"))
    return rows.select("id", "x.mark", T.text_corruption(F.col("x.text")).alias("broken"))


DENSE = r"""(length({0}) >= 90 AND len(regexp_extract_all({0}, '[-+]?[0-9]+([.,][0-9]+)?%?')) >= 6 AND (len(regexp_extract_all({0}, '[0-9%+−-]')) / length({0}) >= 0.18
  OR len(regexp_extract_all({0}, '[0-9]([.,][0-9]+)?%')) >= 2 OR len(regexp_extract_all({0}, '[：:；;|｜]')) >= 3 OR len(regexp_extract_all({0}, '(?i)\b(ms|s|MB|GB|TB|Hz|kHz|MHz|GHz|req/s|tokens?/s)\b')) >= 3))"""


@query("dense_data_block", f", l AS (SELECT id, {SPACED.format('body')} AS t FROM library_documents UNION ALL SELECT concat(id, 'n'), {SPACED.format("concat('load: ', CAST(number AS VARCHAR(20)), ' MB 12.5% 7 ms | 3 s 4 5 6 ', body)")} FROM library_documents) SELECT id, {DENSE.format('t')} AS dense FROM l", ("library_documents",))
def dense_data_block(lib: Library) -> DataFrame:
    plain = lib.library_documents.select("id", "number", "body")
    figures = plain.select(F.concat("id", F.lit("n")).alias("id"), F.concat(F.lit("load: "), F.col("number").cast("string"), F.lit(" MB 12.5% 7 ms | 3 s 4 5 6 "), F.col("body")).alias("body"))
    return plain.select("id", "body").unionByName(figures).select("id", T.dense_data(F.col("body")).alias("dense"))


@query(
    "classify_block",
    rf""", l AS (SELECT unnest(string_split(body, chr(10))) AS raw FROM library_documents), b AS (SELECT trim(raw) AS t FROM l)
    SELECT CASE WHEN regexp_matches(t, '^([-*•]|[0-9]+[.)])\s') THEN 'list' WHEN length(t) <= 48 AND NOT regexp_matches(t, '[.!?。！？]$') AND t <> '' THEN 'heading' WHEN {DENSE.format(SPACED.format("t"))} THEN 'data' ELSE 'paragraph' END AS kind, count(*) AS blocks FROM b GROUP BY ALL""",
    ("library_documents",),
)
def classify_block(lib: Library) -> DataFrame:
    return lib.library_documents.select(F.explode(F.split("body", "\n")).alias("line")).groupBy(T.block_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("blocks"))


@query("title_key", r"SELECT id, regexp_replace(lower(title), '[\s\p{P}\p{S}]+', '', 'g') AS key FROM library_documents", ("library_documents",))
def title_key(lib: Library) -> DataFrame:
    return lib.library_documents.select("id", T.title_key(F.col("title")).alias("key"))


@query("strip_markdown", r"SELECT id, trim(regexp_replace(concat(title, ' ', title), '[*_`~]+', '', 'g')) AS text FROM library_documents", ("library_documents",))
def strip_markdown(lib: Library) -> DataFrame:
    marked = F.concat(F.lit("# **"), F.col("title"), F.lit("** ["), F.col("title"), F.lit("](http://x.example/y)"))
    return lib.library_documents.select("id", T.strip_markdown(marked).alias("text"))


@query("compact_count", "SELECT full_name, CAST(stars * 1000 + 500 AS BIGINT) AS n, stars AS plain FROM repositories", ("repositories",))
def compact_count(lib: Library) -> DataFrame:
    return lib.repositories.select("full_name", T.compact_count(F.concat(F.col("stars").cast("string"), F.lit(".5k"))).alias("n"), T.compact_count(F.col("stars").cast("string")).alias("plain"))


@query("segment_label", "SELECT seq, concat(CASE WHEN seq // 3600 > 0 THEN concat(lpad(CAST(seq // 3600 AS VARCHAR), 2, '0'), ':') ELSE '' END, lpad(CAST(seq % 3600 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(seq % 60 AS VARCHAR), 2, '0')) AS label FROM ticks", ("ticks",))
def segment_label(lib: Library) -> DataFrame:
    return lib.ticks.select("seq", T.clock(F.col("seq")).alias("label"))


@query("iso_week_key", "SELECT concat(CAST(isoyear(created_at) AS VARCHAR), '-W', lpad(CAST(weekofyear(created_at) AS VARCHAR), 2, '0')) AS week, count(*) AS jobs FROM jobs GROUP BY ALL", ("jobs",))
def iso_week_key(lib: Library) -> DataFrame:
    return lib.jobs.groupBy(T.iso_week(F.to_date("created_at")).alias("week")).agg(F.count("*").alias("jobs"))


@query("scan_raw_pages", "SELECT id, octet_length(encode(body)) AS bytes FROM library_articles WHERE trim(body) <> '' AND octet_length(encode(body)) <= 15000000", ("library_articles",))
def scan_raw_pages(lib: Library) -> DataFrame:
    return pages.raw_pages(lib.pages).select(F.col("page_id").cast("string").alias("id"), F.octet_length("html").cast("long").alias("bytes"))


COUNTS = ", ".join(f"len(regexp_extract_all(lower(html), '{p}')) AS {n}" for n, p in pages.STRUCTURES.items())


@query("structure_counts", f"SELECT page_id, {COUNTS} FROM pages")
def structure_counts(lib: Library) -> DataFrame:
    return lib.pages.select("page_id", *pages.structure_counts(F.col("html")))


@query(
    "page_metadata",
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z-]+)"', 1) AS lang, length(regexp_extract(html, '<meta name="description" content="([^"]*)"', 1)) AS description_chars FROM pages""",
)
def page_metadata(lib: Library) -> DataFrame:
    return pages.page_metadata(lib.pages)


_A, _B = (", ".join(f"len(regexp_extract_all(lower({c}), '{p}')) AS {c}_{n}" for n, p in pages.STRUCTURES.items()) for c in ("s", "t"))
_LOST = ", ".join([f"CASE WHEN t_{n} < s_{n} THEN '{n}' END" for n in pages.STRUCTURES if n != "headings"] + ["CASE WHEN t_headings < 0.7 * s_headings THEN 'headings' END"])


@query(
    "translation_fidelity",
    rf"""WITH p AS (SELECT page_id, html AS s, CASE WHEN page_id % 2 = 0 THEN html ELSE regexp_replace(html, '<(a|h2)[^>]*>', '', 'g') END AS t FROM pages), c AS (SELECT page_id, {_A}, {_B} FROM p),
    m AS (SELECT page_id, array_to_string(list_filter([{_LOST}], lambda x: x IS NOT NULL), ',') AS missing FROM c)
    SELECT page_id, missing, CASE WHEN missing = '' THEN 'complete' ELSE 'degraded' END AS status FROM m""",
)
def translation_fidelity(lib: Library) -> DataFrame:
    pairs = lib.pages.select("page_id", F.col("html").alias("s"), F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.regexp_replace("html", "<(a|h2)[^>]*>", "")).alias("t"))
    return pages.translation_fidelity(pairs, "s", "t").select("page_id", "missing", "status")


@query(
    "protected_markers",
    """SELECT id, number % 4 <> 0 AS kept FROM library_documents""",
    ("library_documents",),
)
def protected_markers(lib: Library) -> DataFrame:
    source = F.concat(F.lit("[[IMG1]] "), F.col("title"), F.lit(" [[MATH2]] [[IMG1]]"))
    output = F.when(F.col("number") % 4 == 0, F.concat(F.lit("[[MATH2]] [[IMG1]]"), "title")).otherwise(F.concat(F.lit("[[MATH2]][[IMG1]] [[IMG1]]"), "title"))
    return pages.protected_markers(lib.library_documents.select("id", source.alias("s"), output.alias("o")), "s", "o").select("id", "kept")


ALLOWED = ["html", "head", "body", "title", "meta", "p", "a", "h1", "h2", "h3", "ul", "ol", "li", "img", "b", "i", "em", "strong", "div", "span"]


@query(
    "translation_html_violations",
    f"""WITH t AS (SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(x)))) AS tag FROM pages)
    SELECT page_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM t WHERE tag NOT IN ({", ".join(f"'{x}'" for x in ALLOWED)}) GROUP BY page_id""",
)
def translation_html_violations(lib: Library) -> DataFrame:
    return pages.html_violations(lib.pages, ALLOWED)


@query("page_links", """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(lib: Library) -> DataFrame:
    return pages.links(lib.pages)
