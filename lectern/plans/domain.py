"""Notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import notes
from lectern.plans.registry import query
from lectern.plans.search import FOLD
from lectern.sources.library import Library
from lectern.sources.shared import shared_path

LINES = r"""
    raw AS (SELECT target_id, turn, unnest(string_split(note_text, chr(10))) AS line, generate_subscripts(string_split(note_text, chr(10)), 1) - 1 AS pos FROM notes),
    lines AS (SELECT * FROM (SELECT target_id, turn, pos, trim(regexp_replace(regexp_replace(regexp_replace(line, '^#{1,6}\s*', ''), '^[-*+]\s+', ''), '^[0-9]+[.)、]\s*', '')) AS line FROM raw)
              WHERE length(line) >= 3 AND NOT regexp_matches(line, '^(核心问题|我的理解|证据与局限|下一步行动)$'))"""
QUESTION, ACTION = "[?？]|^(为什么|如何|是否|疑问|问题)", "(?i)(下一步|待办|TODO|行动|尝试|验证|补充|复现|阅读)"


@query("note_lines", f", {LINES} SELECT target_id, turn, CAST(pos AS INTEGER) AS pos, line FROM lines", ("notes",))
def note_lines(lib: Library) -> DataFrame:
    return notes.note_lines(lib.notes)


@query(
    "note_digest",
    f""", {LINES} SELECT target_id, count(DISTINCT turn) AS notes, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(line, '{QUESTION}')) AS questions, arg_min(line, (turn, pos)) AS first_line FROM lines GROUP BY target_id""",
    ("notes",),
)
def note_digest(lib: Library) -> DataFrame:
    return notes.note_digest(lib.notes)


@query("key_points", f", {LINES} SELECT target_id, CAST(n AS INTEGER) AS n, line FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY turn, pos) AS n FROM lines) WHERE n <= 2", ("notes",))
def key_points(lib: Library) -> DataFrame:
    return notes.key_points(lib.notes)


@query(
    "list_notes",
    f""", r AS (SELECT 'document' AS target_type, n.target_id, CASE WHEN c.title = '' THEN '未命名资料' ELSE coalesce(c.title, '未命名资料') END AS title, CASE WHEN c.category = '' THEN '未分类' ELSE coalesce(c.category, '未分类') END AS category, n.updated_at, false AS own
           FROM notes n JOIN content c ON c.target_type = 'document' AND c.target_id = n.target_id
           WHERE trim(n.note_text) <> '' AND contains({FOLD.format("concat(n.note_text, ' ', coalesce(c.title, ''), ' ', coalesce(c.category, ''))")}, 'ention')),
    o AS (SELECT 'text', id, title, NULL, updated_at, true FROM library_papers WHERE contains({FOLD.format("concat(title, ' ', body)")}, 'ention')),
    a AS (SELECT * FROM r UNION ALL SELECT * FROM o),
    p AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, target_id, target_type) AS place, count(*) OVER () AS total FROM a)
    SELECT place, target_type, target_id, title, category, CAST(updated_at AS VARCHAR) AS updated_at, CASE WHEN own THEN 0 ELSE (SELECT count(*) FROM messages m WHERE m.role <> 'user' AND m.conversation_id = p.target_id AND trim(m.text) <> '') END AS annotations, total, total > 45 AS has_more
    FROM p WHERE place > 5 AND place <= 45""",
    ("content", "notes", "messages", "library_papers"),
)
def list_notes(lib: Library) -> DataFrame:
    """Notes on documents, papers as notes of their own, answers as annotations."""
    own = lib.library_papers.select(F.lit("text").alias("note_type"), "id", "title", F.col("body").alias("content_text"), "updated_at")
    reading = lib.notes.select(F.lit("document").alias("target_type"), "target_id", "note_text", "updated_at")
    answers = lib.messages.where("role <> 'user'").select(F.lit("document").alias("target_type"), F.col("conversation_id").alias("target_id"), F.lit("").alias("quote_text"), F.col("text").alias("note_text"))
    return notes.list_all_notes(reading, own, lib.content, answers, "Ention", limit=40, offset=5)


TOLD = """, t AS (SELECT n.*, CASE WHEN turn % 3 = 0 THEN '未分类' ELSE concat('turn ', CAST(turn % 3 AS VARCHAR(9))) END AS theme FROM notes n WHERE trim(note_text) <> '')"""


def themed(lib: Library) -> DataFrame:
    category = F.when(F.col("turn") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("turn "), (F.col("turn") % 3).cast("string")))
    return lib.notes.withColumns({"category": category, "target_type": F.lit("document"), "title": F.concat(F.lit("item "), "target_id")})


@query(
    "digest_overview",
    f"""{TOLD}, o AS (SELECT count(*) AS notes, count(DISTINCT target_id) AS sources, count(DISTINCT theme) AS themes FROM t)
    SELECT *, concat('本期整理了 ', notes, ' 条笔记，来自 ', sources, ' 份资料，归入 ', themes, ' 个主题。') AS overview FROM o""",
    ("notes",),
)
def digest_overview(lib: Library) -> DataFrame:
    return notes.digest_overview(themed(lib))


@query(
    "digest_sources",
    f"""{TOLD}, c AS (SELECT theme, count(*) AS theme_notes, row_number() OVER (ORDER BY count(*) DESC, theme) AS place FROM t GROUP BY theme)
    SELECT DISTINCT theme, place, theme_notes, 'document' AS target_type, target_id, concat('item ', target_id) AS title FROM t JOIN c USING (theme)""",
    ("notes",),
)
def digest_sources(lib: Library) -> DataFrame:
    return notes.digest_sources(themed(lib))


@query("note_library_summary", "SELECT count(*) AS notes, count(DISTINCT target_id) AS items, CAST(max(updated_at) AS VARCHAR) AS latest FROM notes", ("notes",))
def note_library_summary(lib: Library) -> DataFrame:
    return notes.note_library_summary(lib.notes)


ENDS = ("2024-01-01 06:00:00", "2024-01-02 00:00:00", "2024-01-15 00:00:00")


@query(
    "incremental_digest",
    f""", {LINES}, runs AS (SELECT *, lag(period_end) OVER (ORDER BY period_end) AS period_start FROM (VALUES {", ".join(f"('{e}')" for e in ENDS)}) t(period_end)),
    n AS (SELECT n.target_id, n.turn, r.period_start, r.period_end FROM notes n JOIN runs r ON trim(note_text) <> '' AND n.updated_at <= CAST(r.period_end AS TIMESTAMP) AND (r.period_start IS NULL OR n.updated_at > CAST(r.period_start AS TIMESTAMP))),
    l AS (SELECT period_end, target_id, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(line, '{QUESTION}')) AS questions, arg_min(line, (turn, pos)) AS first_line FROM lines JOIN n USING (target_id, turn) GROUP BY ALL)
    SELECT target_id, notes, coalesce(lines, 0) AS lines, coalesce(questions, 0) AS questions, first_line, period_start, period_end
    FROM (SELECT target_id, period_start, period_end, count(*) AS notes FROM n GROUP BY ALL) LEFT JOIN l USING (period_end, target_id)""",
    ("notes",),
)
def incremental_digest(lib: Library) -> DataFrame:
    """Three runs and one again."""
    runs = notes.Digests(lib.spark, shared_path(lib.spark, "digests"))
    for end in (*ENDS, ENDS[-1]):
        runs.run(lib.notes, end)
    return runs.digests()


@query(
    "digest_points",
    f""", {LINES}, p AS (SELECT l.*, updated_at, row_number() OVER (PARTITION BY target_id, turn ORDER BY pos) AS own FROM lines l JOIN notes USING (target_id, turn)),
    k AS (SELECT 'key' AS kind, 10 AS most, * FROM p WHERE own <= 2 UNION ALL SELECT 'question', 8, * FROM p WHERE regexp_matches(line, '{QUESTION}') UNION ALL SELECT 'action', 8, * FROM p WHERE regexp_matches(line, '{ACTION}')),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY updated_at, target_id, turn, pos) AS n, trim(regexp_replace(line, '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM k)
    SELECT kind, CAST(n AS INTEGER) AS n, target_id, turn, CASE WHEN length(t) > 180 THEN concat(substr(t, 1, 180), '…') ELSE t END AS text FROM r WHERE n <= most""",
    ("notes",),
)
def digest_points(lib: Library) -> DataFrame:
    return notes.digest_points(lib.notes)


@query(
    "digest_themes",
    """, n AS (SELECT target_id, CASE WHEN turn % 3 = 0 THEN 'unsorted' ELSE concat('turn ', CAST(turn % 3 AS VARCHAR(9))) END AS theme FROM notes WHERE trim(note_text) <> '')
    SELECT theme, count(*) AS notes, count(DISTINCT target_id) AS sources FROM n GROUP BY theme UNION ALL SELECT '(all)', count(*), count(DISTINCT target_id) FROM n""",
    ("notes",),
)
def digest_themes(lib: Library) -> DataFrame:
    category = F.when(F.col("turn") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("turn "), (F.col("turn") % 3).cast("string")))
    return notes.digest_themes(lib.notes.withColumn("category", category))
