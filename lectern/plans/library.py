"""Lists, gates and requests over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import detect_language
from lectern.operators import hierarchy, jobs, layout, library, maintenance, organize, search
from lectern.plans.items import CLOSURE
from lectern.plans.registry import query
from lectern.plans.search import FOLD
from lectern.plans.texts import COUNTED, SCRIPT, SPACED
from lectern.sources.library import Library

KEYS = ["target_type", "target_id"]
NOTES = "item_notes AS (SELECT 'document' AS target_type, target_id, note_text, updated_at FROM notes)"


def item_notes(lib: Library) -> DataFrame:
    return lib.notes.select(F.lit("document").alias("target_type"), "target_id", "note_text", "updated_at")


@query("content_summary", "SELECT target_type, target_id, CASE WHEN trim(title) <> '' THEN title ELSE target_id END AS title, substr(CASE WHEN trim(summary) <> '' THEN summary WHEN trim(title) <> '' THEN title ELSE target_id END, 1, 220) AS summary FROM content", ("content",))
def content_summary(lib: Library) -> DataFrame:
    return library.content_summary(lib.content)


@query("join_hit_content", "SELECT target_type, target_id, title FROM content WHERE (target_type, target_id) IN (SELECT (target_type, target_id) FROM favorites UNION SELECT (target_type, target_id) FROM content_tags WHERE tag_name = 'fr')", ("content", "favorites", "content_tags"))
def join_hit_content(lib: Library) -> DataFrame:
    return library.join_hits(lib.content, lib.favorites, lib.content_tags.where("tag_name = 'fr'")).select(*KEYS, "title")


@query(
    "match_fallback_notes",
    f""", {NOTES}, own AS (SELECT 'document' AS target_type, id AS target_id, 'title' AS field FROM library_documents WHERE contains({FOLD.format("title")}, 'the')),
    more AS (SELECT target_type, target_id, row_number() OVER (PARTITION BY target_type, target_id ORDER BY updated_at DESC, note_text) AS n FROM item_notes
             WHERE contains({FOLD.format("note_text")}, 'the') AND (target_type, target_id) NOT IN (SELECT (target_type, target_id) FROM own))
    SELECT * FROM own UNION ALL SELECT target_type, target_id, 'note' FROM more WHERE n = 1""",
    ("library_documents", "notes"),
)
def match_fallback_notes(lib: Library) -> DataFrame:
    return search.fallback_hits(search.hits_in(lib.library_documents, "document", ["title"], "the"), item_notes(lib), "the").select(*KEYS, "field")


PAPERS = "papers AS (SELECT 'document' AS target_type, id AS target_id, number, title, body, updated_at FROM library_documents)"


@query(
    "list_papers_filtered",
    f""", {CLOSURE}, {PAPERS} SELECT target_id, title FROM papers WHERE contains({FOLD.format("concat_ws(' ', title, body)")}, 'ention')
    AND (target_type, target_id) IN (SELECT (target_type, target_id) FROM content_folders WHERE folder_id IN (SELECT descendant FROM closure WHERE ancestor = 'r2')) ORDER BY updated_at DESC, number LIMIT 24""",
    ("library_documents", "content_folders", "folders"),
)
def list_papers_filtered(lib: Library) -> DataFrame:
    papers = lib.library_documents.select(F.lit("document").alias("target_type"), F.col("id").alias("target_id"), "number", "title", "body", "updated_at")
    below = hierarchy.folder_closure(lib.folders).where("ancestor = 'r2'").select(F.col("descendant").alias("folder_id"))
    return library.list_papers(papers, lib.content_folders, below, "ention", [F.col("updated_at").desc(), "number"], 24).select("target_id", "title")


@query("recent_imports", "SELECT target_type, target_id, title FROM content ORDER BY updated_at DESC, target_type, target_id LIMIT 12", ("content",))
def recent_imports(lib: Library) -> DataFrame:
    return organize.newest(lib.content, 12).select(*KEYS, "title")


@query("topic_counts", "SELECT f.id AS folder_id, f.name, count(c.target_id) AS items FROM folders f LEFT JOIN content_folders c ON c.folder_id = f.id GROUP BY ALL", ("folders", "content_folders"))
def topic_counts(lib: Library) -> DataFrame:
    return library.counts_with_zeros(lib.folders.select(F.col("id").alias("folder_id"), "name"), lib.content_folders, "folder_id")


@query(
    "topic_items",
    """SELECT folder_id, target_type, target_id, title, coalesce((SELECT string_agg(DISTINCT tag_name, ',' ORDER BY tag_name) FROM content_tags t WHERE t.target_type = c.target_type AND t.target_id = c.target_id), '') AS tags
    FROM content_folders m JOIN content c USING (target_type, target_id)""",
    ("content_folders", "content", "content_tags"),
)
def topic_items(lib: Library) -> DataFrame:
    return library.topic_items(lib.content_folders, lib.content, lib.content_tags).select("folder_id", *KEYS, "title", "tags")


@query(
    "duplicate_articles",
    r""", n AS (SELECT id, number, updated_at, split_part(url, '?', 1) AS url, nullif(regexp_replace(lower(title), '[\s\p{P}\p{S}]+', '', 'g'), '') AS title, CASE WHEN length(body) >= 80 THEN sha256(body) END AS content FROM library_articles),
    p AS (SELECT a.id, k.reason, k.rank, b.id AS match_id, b.updated_at FROM (VALUES ('url', 1), ('title', 2), ('content', 3)) k(reason, rank), n a, n b
          WHERE a.number % 2 = 1 AND b.number % 2 = 0 AND ((k.reason = 'url' AND a.url = b.url) OR (k.reason = 'title' AND a.title = b.title) OR (k.reason = 'content' AND a.content = b.content)))
    SELECT id, reason, match_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, updated_at, match_id) AS n FROM p) WHERE n = 1""",
    ("library_articles",),
)
def duplicate_articles(lib: Library) -> DataFrame:
    rows = lib.library_articles.withColumn("url", F.split_part("url", F.lit("?"), F.lit(1)))
    return library.duplicate_articles(rows.where("number % 2 = 1"), rows.where("number % 2 = 0"))


@query(
    "backfill_language",
    f""", l AS (SELECT id, lang, {SPACED.format("body")} AS t FROM library_documents), c AS (SELECT id, lang, {COUNTED} FROM l), s AS (SELECT id, lang, {SCRIPT} AS language FROM c)
    SELECT id, language, CASE WHEN language = 'en' THEN 'not_requested' ELSE 'not_required' END AS translation FROM s WHERE language <> lang""",
    ("library_documents",),
)
def backfill_language(lib: Library) -> DataFrame:
    rows = library.backfill(lib.library_documents.select("id", "body", F.col("lang").alias("language")), "language", detect_language(F.col("body")))
    return rows.select("id", "language", library.translation_need(F.col("language")).alias("translation"))


@query("needs_ocr", "SELECT id, CASE number % 3 WHEN 0 THEN true WHEN 1 THEN length(trim(body)) < 80 ELSE false END AS ocr FROM library_documents", ("library_documents",))
def needs_ocr(lib: Library) -> DataFrame:
    extension = F.when(F.col("number") % 3 == 0, "png").when(F.col("number") % 3 == 1, "pdf").otherwise("txt")
    return lib.library_documents.select("id", library.needs_ocr(extension, F.col("body")).alias("ocr"))


@query(
    "upsert_repositories",
    """, o AS (SELECT lower(full_name) AS key, full_name, stars FROM repositories WHERE stars % 3 <> 0), n AS (SELECT lower(upper(full_name)) AS key, upper(full_name) AS full_name, stars + 1 AS stars FROM repositories WHERE stars % 2 = 0)
    SELECT coalesce(o.key, n.key) AS key, coalesce(o.full_name, n.full_name) AS full_name, coalesce(n.stars, o.stars) AS stars FROM o FULL JOIN n ON o.key = n.key""",
    ("repositories",),
)
def upsert_repositories(lib: Library) -> DataFrame:
    old = lib.repositories.where("stars % 3 <> 0").select(F.lower("full_name").alias("key"), "full_name", "stars")
    new = lib.repositories.where("stars % 2 = 0").select(F.lower(F.upper("full_name")).alias("key"), F.upper("full_name").alias("full_name"), (F.col("stars") + 1).alias("stars"))
    return maintenance.upsert_by_policy(old, new, ["key"], {"full_name": maintenance.keep, "stars": maintenance.replace})


@query("translation_requests", "SELECT id, 'queued' AS status, CAST(0 AS BIGINT) AS progress FROM jobs WHERE status NOT IN ('running', 'completed')", ("jobs",))
def translation_requests(lib: Library) -> DataFrame:
    rows = lib.jobs.select("id", F.when(F.col("status") == "completed", "ready").otherwise(F.col("status")).alias("status"), F.lit(5).cast("long").alias("progress"))
    return library.translation_requests(rows)


@query("translation_progress", "SELECT id, CAST(CASE status WHEN 'completed' THEN 100 WHEN 'running' THEN greatest(1, least(99, number % 130 - 5)) ELSE 0 END AS BIGINT) AS progress FROM jobs", ("jobs",))
def translation_progress(lib: Library) -> DataFrame:
    return lib.jobs.select("id", library.progress(F.col("number") % 130 - 5, F.col("status")).alias("progress"))


@query("valid_cards", "SELECT id, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'concept' END AS kind FROM library_documents WHERE trim(title) <> '' AND number % 4 <> 0", ("library_documents",))
def valid_cards(lib: Library) -> DataFrame:
    cards = lib.library_documents.select("id", F.col("title").alias("front"), F.when(F.col("number") % 4 != 0, F.col("summary")).alias("back"), F.col("lang").alias("kind"))
    return library.valid_cards(cards, ["en", "fr"], "concept").select("id", "kind")


@query("retry_outcome", "SELECT job_id, CASE WHEN max(seq) % 2 = 0 AND count(*) < 4 THEN 'retry' ELSE 'terminal' END AS outcome FROM attempts GROUP BY job_id", ("attempts",))
def retry_outcome(lib: Library) -> DataFrame:
    rows = lib.attempts.groupBy("job_id").agg(F.count("*").alias("n"), F.max("seq").alias("seq"))
    status = F.when(F.col("seq") % 2 == 0, 503).otherwise(400)
    return library.retry_outcome(rows, jobs.transient(status, F.lit("")), F.col("n"), 4).select("job_id", "outcome")


@query("storage_usage", "SELECT category AS kind, count(*) AS files, CAST(sum(length(body)) AS BIGINT) AS bytes, arg_max(id, (updated_at, id)) AS newest FROM library_documents GROUP BY category", ("library_documents",))
def storage_usage(lib: Library) -> DataFrame:
    return library.storage_usage(lib.library_documents.select(F.col("category").alias("kind"), F.col("id").alias("path"), F.col("updated_at").alias("made_at"), F.length("body").cast("long").alias("bytes")))


@query("owner_snapshot", "SELECT 'states' AS part, count(*) AS rows FROM reading_states WHERE owner_id = 7 UNION ALL SELECT 'ticks', count(*) FROM ticks WHERE owner_id = 7", ("reading_states", "ticks"))
def owner_snapshot(lib: Library) -> DataFrame:
    own = library.owner_snapshot({"states": lib.reading_states, "ticks": lib.ticks}, 7)
    counts = [rows.agg(F.count("*").alias("rows")).select(F.lit(n).alias("part"), "rows") for n, rows in own.items()]
    return counts[0].unionByName(counts[1])


@query("locate_selection", "SELECT id, quote, \"offset\" FROM (SELECT id, substr(body, 10, 25) AS quote, strpos(body, substr(body, 10, 25)) - 1 AS \"offset\" FROM library_documents WHERE number % 5 <> 0) WHERE \"offset\" >= 0", ("library_documents",))
def locate_selection(lib: Library) -> DataFrame:
    picked = lib.library_documents.select("id", F.when(F.col("number") % 5 != 0, F.substring("body", 10, 25)).otherwise("☃ not there").alias("quote"))
    return library.locate_selection(picked, lib.library_documents)


@query("paragraphs_to_html", "SELECT id, concat('<p>', array_to_string(list_filter(list_transform(regexp_split_to_array(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\n\\s*\\n'), lambda x: trim(x)), lambda x: x <> ''), concat('</p>', chr(10), '<p>')), '</p>') AS html FROM library_documents WHERE trim(body) <> ''", ("library_documents",))
def paragraphs_to_html(lib: Library) -> DataFrame:
    return lib.library_documents.where("trim(body) <> ''").select("id", library.paragraphs_to_html(F.col("body")).alias("html"))


@query(
    "sink_markdown_export",
    f""", {NOTES}, n AS (SELECT target_type, target_id, string_agg(concat('> ', note_text), chr(10) ORDER BY updated_at, note_text) AS notes FROM item_notes GROUP BY ALL)
    SELECT target_type, target_id, sha256(concat_ws(chr(10), concat('# ', title), concat('*', category, '*'), notes)) AS digest FROM content LEFT JOIN n USING (target_type, target_id)""",
    ("content", "notes"),
)
def sink_markdown_export(lib: Library) -> DataFrame:
    return library.markdown_export(lib.content, item_notes(lib)).select(*KEYS, F.sha2("markdown", 256).alias("digest"))


@query(
    "reading_workspace",
    f""", {NOTES}, s AS (SELECT target_type, target_id, max(progress) AS progress, count(*) AS readers FROM reading_states GROUP BY ALL), n AS (SELECT target_type, target_id, count(*) AS notes FROM item_notes GROUP BY ALL)
    SELECT target_type, target_id, title, coalesce(progress, 0) AS progress, coalesce(readers, 0) AS readers, CAST(coalesce(notes, 0) AS INTEGER) AS notes FROM content LEFT JOIN s USING (target_type, target_id) LEFT JOIN n USING (target_type, target_id)""",
    ("content", "notes", "reading_states"),
)
def reading_workspace(lib: Library) -> DataFrame:
    return organize.reading_workspace(lib.content, lib.reading_states, item_notes(lib))


@query(
    "toc_merge_chunks",
    """, e AS (SELECT conversation_id AS id, turn AS pos, role AS title FROM messages WHERE turn > 1), r AS (SELECT *, lag(title) OVER (PARTITION BY id ORDER BY pos) IS DISTINCT FROM title AS new FROM e),
    n AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY id ORDER BY pos) AS run FROM r)
    SELECT id, title, min(pos) AS first, max(pos) AS last, count(*) AS parts FROM n GROUP BY id, run, title""",
    ("messages",),
)
def toc_merge_chunks(lib: Library) -> DataFrame:
    entries = lib.messages.where("turn > 1").select(F.col("conversation_id").alias("id"), F.col("turn").alias("pos"), F.concat("role", F.lit(" ("), F.col("turn").cast("string"), F.lit("/9)")).alias("title"))
    return library.merge_chunk_titles(entries)


def _last(mark: str) -> str:
    return f"CASE WHEN strpos(reverse(cand), reverse({mark})) > 0 THEN length(cand) - strpos(reverse(cand), reverse({mark})) - length({mark}) + 1 ELSE -1 END"


@query(
    "chunk_overlap",
    f""", steps AS (
      SELECT id, body, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop, CAST(0 AS BIGINT) AS ahead FROM library_documents WHERE length(body) > 0
      UNION ALL
      SELECT id, body, n + 1, ahead, stop, CASE WHEN stop >= length(body) THEN length(body) ELSE greatest(ahead + 1, stop - 120) END
      FROM (SELECT *, CASE WHEN ideal < length(body) AND spot >= 0 THEN ahead + 780 + spot + 1 ELSE ideal END AS stop FROM (
        SELECT *, greatest({_last("chr(10) || chr(10)")}, {_last("'。'")}, {_last("'；'")}, {_last("'. '")}) AS spot FROM (
          SELECT id, body, n, ahead, least(length(body), ahead + 1200) AS ideal, substr(body, ahead + 781, greatest(0, least(length(body), ahead + 1200) - ahead - 780)) AS cand FROM steps WHERE ahead < length(body))))
    )
    SELECT concat(id, '-C', CAST(n AS VARCHAR)) AS chunk_id, id, start, stop, sha256(trim(substr(body, start + 1, stop - start), chr(32) || chr(9) || chr(10) || chr(13))) AS digest
    FROM steps WHERE n > 0 AND length(trim(substr(body, start + 1, stop - start), chr(32) || chr(9) || chr(10) || chr(13))) >= 40""",
    ("library_documents",),
)
def chunk_overlap(lib: Library) -> DataFrame:
    return library.chunk_overlap(lib.library_documents).select("chunk_id", "id", "start", "stop", F.sha2("text", 256).alias("digest"))


@query(
    "section_pack",
    """, sizes AS (SELECT id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM library_documents),
    b AS (SELECT id, pos, length(line) AS size, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM sizes),
    p AS (SELECT id, pos, n, size AS used, 0 AS section FROM b WHERE n = 1
          UNION ALL SELECT b.id, b.pos, b.n, CASE WHEN p.used > 0 AND p.used + b.size > 600 THEN b.size ELSE p.used + b.size END, p.section + CASE WHEN p.used > 0 AND p.used + b.size > 600 THEN 1 ELSE 0 END FROM p JOIN b ON b.id = p.id AND b.n = p.n + 1)
    SELECT id, CAST(pos - 1 AS INTEGER) AS pos, CAST(section AS INTEGER) AS section FROM p""",
    ("library_documents",),
)
def section_pack(lib: Library) -> DataFrame:
    blocks = lib.library_documents.select("id", F.posexplode(F.split("body", "\n")).alias("pos", "line")).select("id", "pos", F.length("line").cast("long").alias("size"))
    return layout.section_pack(blocks, 600)


HEADING = r"""CASE WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN length(regexp_extract(line, '^(#{1,6})\s', 1))
         WHEN regexp_matches(line, '(?i)^(chapter|part)\s+([0-9]+|[ivxlc]+)\b') AND length(line) <= 80 THEN 1
         WHEN regexp_matches(line, '^[0-9]{1,2}(\.[0-9]{1,2}){0,3}\.?\s+[A-Za-z一-鿿]') AND length(line) <= 80 AND NOT regexp_matches(line, '^[0-9.]+\s*(%|px|km|kg|mm|cm|ms|s|GB|MB|years?|days?|times)\b')
         THEN length(regexp_extract(line, '^([0-9]{1,2}(\.[0-9]{1,2}){0,3})', 1)) - length(replace(regexp_extract(line, '^([0-9]{1,2}(\.[0-9]{1,2}){0,3})', 1), '.', '')) + 1 END"""


@query(
    "parse_heading",
    rf""", l AS (SELECT unnest(string_split(body, chr(10))) AS line FROM library_documents), v AS (SELECT concat(p, line) AS line FROM l, (VALUES (''), ('2.1 '), ('12 ms '), ('Chapter iv '), ('## '), ('1.2.3. ')) t(p))
    SELECT {HEADING} AS level, count(*) AS lines FROM v GROUP BY ALL""",
    ("library_documents",),
)
def parse_heading(lib: Library) -> DataFrame:
    """All lines, as they are and behind marks and numbers."""
    marks = F.explode(F.array(*map(F.lit, ("", "2.1 ", "12 ms ", "Chapter iv ", "## ", "1.2.3. "))))
    lines = lib.library_documents.select(F.explode(F.split("body", "\n")).alias("line")).select("line", marks.alias("mark")).select(F.concat("mark", "line").alias("line"))
    return lines.groupBy(layout.heading(F.col("line"))["level"].alias("level")).agg(F.count("*").alias("lines"))
