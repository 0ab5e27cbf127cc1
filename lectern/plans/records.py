"""Records over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import organize, records
from lectern.plans.registry import query
from lectern.plans.search import FOLD
from lectern.sources.files import json_column
from lectern.sources.library import Library

KEYS = ["target_type", "target_id"]
#: upper() of Unicode, as Spark has it: 102 characters become several, which the reference's upper() leaves or maps otherwise.
UPPER = reduce(lambda s, c: f"replace({s}, '{c}', '{c.upper()}')", (chr(n) for n in range(0x80, 0xFB18) if len(chr(n).upper()) > 1), "title")


@query(
    "upsert_papers",
    f""", o AS (SELECT id, title, body AS text, length(body) AS words FROM library_papers WHERE number % 3 <> 0), n AS (SELECT id, CASE WHEN number % 2 = 0 THEN ' ' ELSE upper({UPPER}) END AS title, CASE WHEN number % 5 = 0 THEN '' ELSE 'new' END AS text, 300 AS words FROM library_papers WHERE number % 4 <> 0)
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.title WHEN n.id IS NULL OR coalesce(trim(n.title, ' '), '') = '' THEN o.title ELSE n.title END AS title,
           CASE WHEN o.id IS NULL THEN n.text WHEN n.id IS NULL OR trim(n.text) = '' THEN o.text ELSE n.text END AS text, CAST(CASE WHEN o.id IS NULL THEN n.words WHEN n.id IS NULL THEN o.words ELSE greatest(o.words, n.words) END AS BIGINT) AS words FROM o FULL JOIN n ON o.id = n.id""",
    ("library_papers",),
)
def upsert_papers(lib: Library) -> DataFrame:
    rows = lib.library_papers
    old = rows.where("number % 3 <> 0").select("id", "title", F.col("body").alias("text"), F.length("body").cast("long").alias("words"))
    new = rows.where("number % 4 <> 0").select("id", F.when(F.col("number") % 2 == 0, " ").otherwise(F.upper("title")).alias("title"), F.when(F.col("number") % 5 == 0, "").otherwise("new").alias("text"), F.lit(300).cast("long").alias("words"))
    return records.upsert_papers(old, new)


@query(
    "upsert_candidates",
    """, o AS (SELECT CAST(number % 10 AS BIGINT) AS week, id, title, 'seen' AS status FROM library_documents WHERE number % 3 <> 0), n AS (SELECT CAST(number % 10 AS BIGINT) AS week, id, concat(title, '!') AS title, 'new' AS status FROM library_documents WHERE number % 4 <> 0)
    SELECT coalesce(o.week, n.week) AS week, coalesce(o.id, n.id) AS id, coalesce(n.title, o.title) AS title, coalesce(o.status, n.status) AS status FROM o FULL JOIN n ON o.id = n.id AND o.week = n.week""",
    ("library_documents",),
)
def upsert_candidates(lib: Library) -> DataFrame:
    rows = lib.library_documents.withColumn("week", F.col("number") % 10)
    old = rows.where("number % 3 <> 0").select("week", "id", "title", F.lit("seen").alias("status"))
    return records.upsert_candidates(old, rows.where("number % 4 <> 0").select("week", "id", F.concat("title", F.lit("!")).alias("title"), F.lit("new").alias("status")))


@query(
    "paper_survivors",
    """SELECT category, id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY (CASE WHEN number % 3 = 0 THEN '' ELSE body END) <> '' DESC, updated_at, id) AS n FROM library_documents) WHERE n = 1""",
    ("library_documents",),
)
def paper_survivors(lib: Library) -> DataFrame:
    rows = lib.library_documents.select("category", "id", F.col("updated_at").alias("created_at"), F.when(F.col("number") % 3 == 0, "").otherwise(F.col("body")).alias("text"))
    return records.survivors(rows, "category").select("category", "id")


@query("derive_card_summary", "SELECT id, substr(array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '')[2:], ' '), 1, 110) AS summary FROM library_documents WHERE len(string_split(body, chr(10))) < 900", ("library_documents",))
def derive_card_summary(lib: Library) -> DataFrame:
    return lib.library_documents.where(F.size(F.split("body", "\n")) < 900).select("id", records.card_summary(F.col("body")).alias("summary"))


@query("card_preview", "SELECT id, sha256(CASE WHEN length(body) >= 2000 THEN substr(body, 1, 1000) ELSE body END) AS digest FROM library_documents", ("library_documents",))
def card_preview(lib: Library) -> DataFrame:
    return lib.library_documents.select("id", F.sha2(records.card_preview(F.col("body")), 256).alias("digest"))


@query("filter_cards", f"SELECT id, title FROM library_documents WHERE category = 'src4' AND contains({FOLD.format('concat_ws(chr(32), title, body)')}, 'anthe')", ("library_documents",))
def filter_cards(lib: Library) -> DataFrame:
    return records.filter_cards(lib.library_documents.withColumnRenamed("category", "domain"), "src4", "Anthe").select("id", "title")


@query("annotations_in_order", "SELECT target_id, turn, CAST(row_number() OVER (PARTITION BY target_id ORDER BY updated_at, turn) AS INTEGER) AS place FROM notes", ("notes",))
def annotations_in_order(lib: Library) -> DataFrame:
    return records.annotations_in_order(lib.notes, "target_id", ["updated_at", "turn"]).select("target_id", "turn", "place")


@query(
    "question_sources",
    """, a AS (SELECT conversation_id AS question, turn AS n, CAST(CAST(conversation_id AS BIGINT) * 7 + turn * 40 AS VARCHAR) AS target_id FROM messages), f AS (SELECT * FROM a WHERE n <= 6)
    SELECT question, f.target_id, CASE WHEN trim(summary) <> '' THEN summary ELSE title END AS text FROM f JOIN content c ON c.target_type = 'document' AND c.target_id = f.target_id
    WHERE question NOT IN (SELECT question FROM f WHERE target_id NOT IN (SELECT target_id FROM content WHERE target_type = 'document'))""",
    ("messages", "content"),
)
def question_sources(lib: Library) -> DataFrame:
    asked = lib.messages.select(F.col("conversation_id").alias("question"), F.col("turn").alias("n"), F.lit("document").alias("target_type"), (F.col("conversation_id").cast("long") * 7 + F.col("turn") * 40).cast("string").alias("target_id"))
    return records.question_sources(asked, lib.content).select("question", "target_id", "text")


@query("embedded_asset_check", """, l AS (SELECT DISTINCT number AS page_id, unnest(regexp_extract_all(body, 'href="([^"]*)"', 1)) AS path FROM library_articles) SELECT page_id, path FROM l WHERE path NOT IN (SELECT path FROM l WHERE page_id % 3 = 0)""", ("library_articles",))
def embedded_asset_check(lib: Library) -> DataFrame:
    manifest = lib.pages.where("page_id % 3 = 0").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("path")).distinct()
    return records.embedded_asset_check(lib.pages, manifest, 'href="([^"]*)"')


@query("parse_json_columns", "SELECT event_type, count(*) AS events, CAST(sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS k FROM events GROUP BY event_type")
def parse_json_columns(lib: Library) -> DataFrame:
    parsed = json_column(F.col("props"), "map<string, bigint>", F.expr("cast(map() as map<string, bigint>)"))
    return lib.events.select("event_type", F.coalesce(parsed["k"], F.lit(0)).alias("k")).groupBy("event_type").agg(F.count("*").alias("events"), F.sum("k").alias("k"))


@query("pending_queue", "SELECT id, job_type FROM jobs WHERE status = 'queued' ORDER BY created_at, number LIMIT 100", ("jobs",))
def pending_queue(lib: Library) -> DataFrame:
    return lib.jobs.where("status = 'queued'").orderBy("created_at", "number").limit(100).select("id", "job_type")


@query("day_key", "SELECT concat('daily:', CAST(CAST(ts AS DATE) AS VARCHAR)) AS day, count(*) AS ticks FROM ticks GROUP BY ALL", ("ticks",))
def day_key(lib: Library) -> DataFrame:
    return lib.ticks.groupBy(F.concat(F.lit("daily:"), F.to_date("ts").cast("string")).alias("day")).agg(F.count("*").alias("ticks"))


@query("clean_label", r"SELECT id, trim(regexp_replace(regexp_replace(concat('**', title, '** `x`'), '[*_`~]+', '', 'g'), '[\s\x0B]+', ' ', 'g')) AS label FROM library_documents", ("library_documents",))
def clean_label(lib: Library) -> DataFrame:
    from lectern.functions.text import collapse_blanks, strip_markdown

    return lib.library_documents.select("id", collapse_blanks(strip_markdown(F.concat(F.lit("**"), "title", F.lit("** `x`")))).alias("label"))


@query(
    "activity_dashboard",
    """SELECT 'ticks' AS panel, count(*) AS n FROM ticks UNION ALL SELECT 'items', count(*) FROM content UNION ALL SELECT 'read', count(*) FROM (SELECT DISTINCT target_type, target_id FROM reading_states)
    UNION ALL SELECT 'completed', count(*) FROM reading_states WHERE progress >= 95 UNION ALL SELECT 'unfiled', count(*) FROM content WHERE (target_type, target_id) NOT IN (SELECT (target_type, target_id) FROM content_folders)""",
    ("ticks", "content", "reading_states", "content_folders"),
)
def activity_dashboard(lib: Library) -> DataFrame:
    panels = {"ticks": lib.ticks, "items": lib.content, "read": lib.reading_states.select(*KEYS).distinct(), "completed": lib.reading_states.where("progress >= 95"), "unfiled": organize.unfiled(lib.content, lib.content_folders)}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("panel"), "n") for name, df in panels.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out

