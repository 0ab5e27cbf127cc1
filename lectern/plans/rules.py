"""Rules and articles over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import iso_week
from lectern.operators import articles, hierarchy, rules
from lectern.plans.items import TREE
from lectern.plans.registry import query
from lectern.plans.search import FOLD
from lectern.sources.library import Library

KEYWORDS = {"code": ["token", "license", "http"], "prose": ["ention", "theatre", "ing the"], "lists": [" | ", "1."]}
_TEXT = FOLD.format("concat_ws(' ', title, title, substr(body, 1, 120000))")
_HITS = [" + ".join(f"(length({_TEXT}) - length(replace({_TEXT}, '{w}', ''))) // {len(w)}" for w in words) for words in KEYWORDS.values()]


@query(
    "classify_keywords",
    f""", h AS (SELECT id, {", ".join(f"CAST({x} AS BIGINT) AS h{n}" for n, x in enumerate(_HITS))} FROM library_documents),
    b AS (SELECT id, list_sort([(h0, 0, 'code'), (h1, -1, 'prose'), (h2, -2, 'lists')], 'DESC') AS s FROM h),
    c AS (SELECT id, s[1][1] AS a, s[2][1] AS b, s[1][3] AS name FROM b)
    SELECT id, CASE WHEN a > 0 THEN name ELSE 'other' END AS category, round(CASE WHEN a > 0 THEN least(CAST(0.95 AS DOUBLE), CAST(0.45 AS DOUBLE) + CAST(0.05 AS DOUBLE) * a + CAST(0.05 AS DOUBLE) * (a - b)) ELSE CAST(0.2 AS DOUBLE) END, 2) AS confidence FROM c""",
    ("library_documents",),
)
def classify_keywords(lib: Library) -> DataFrame:
    return rules.classify_keywords(lib.library_documents, KEYWORDS)


TAGS = ["token", "license", "theatre", "example", "phone", "key"]
_HOLDS = FOLD.format("concat_ws(' ', title, body)")


@query(
    "classify_domain_tags",
    f""", p AS (SELECT id, list_filter(['{"', '".join(TAGS)}'], lambda w: contains(t, w)) AS w FROM (SELECT id, {_HOLDS} AS t FROM library_documents)) SELECT id, len(w) AS hits, array_to_string(w[1:2], ',') AS tags FROM p""",
    ("library_documents",),
)
def classify_domain_tags(lib: Library) -> DataFrame:
    return rules.domain_tags(lib.library_documents, TAGS, 2)


WEIGHTS = [("ention", 3), ("th(at|is)", 2), ("[0-9]{4}", 1), ("license", -2)]
_SCORE = " + ".join(f"CASE WHEN regexp_matches({_HOLDS}, '{p}') THEN {w} ELSE 0 END" for p, w in WEIGHTS)
SCORED = f"scored AS (SELECT *, CAST({_SCORE} AS BIGINT) AS score FROM library_documents)"


@query("score_candidates", f", {SCORED} SELECT id, score FROM scored", ("library_documents",))
def score_candidates(lib: Library) -> DataFrame:
    return rules.score_candidates(lib.library_documents, WEIGHTS).select("id", "score")


@query("pick_candidate", f", {SCORED} SELECT category, id, score FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, updated_at DESC, id) AS n FROM scored WHERE score > 0) WHERE n = 1", ("library_documents",))
def pick_candidate(lib: Library) -> DataFrame:
    return rules.pick_candidate(rules.score_candidates(lib.library_documents, WEIGHTS), "category", [F.col("score").desc(), F.col("updated_at").desc(), "id"]).select("category", "id", "score")


@query(
    "weekly_candidates",
    """SELECT concat(CAST(isoyear(created_at) AS VARCHAR), '-W', lpad(CAST(weekofyear(created_at) AS VARCHAR), 2, '0')) AS week, count(DISTINCT job_type) AS topics, count(*) AS candidates
    FROM jobs WHERE status = 'running' GROUP BY ALL HAVING count(DISTINCT job_type) >= 2""",
    ("jobs",),
)
def weekly_candidates(lib: Library) -> DataFrame:
    return rules.weekly_candidates(lib.jobs.where("status = 'running'"), iso_week(F.to_date("created_at")), "job_type")


@query(
    "reminder_due",
    """, c AS (SELECT concat(CAST(isoyear(created_at) AS VARCHAR), '-W', lpad(CAST(weekofyear(created_at) AS VARCHAR), 2, '0')) AS week, status <> 'running' OR number % 2 = 0 AS translated, number FROM jobs),
    s AS (SELECT week FROM c WHERE number % 97 = 0)
    SELECT week, count(*) AS candidates FROM c WHERE week NOT IN (SELECT week FROM s) GROUP BY week HAVING bool_and(translated)""",
    ("jobs",),
)
def reminder_due(lib: Library) -> DataFrame:
    rows = lib.jobs.select(iso_week(F.to_date("created_at")).alias("week"), ((F.col("status") != "running") | (F.col("number") % 2 == 0)).alias("translated"), "number")
    status = rows.where("number % 97 = 0").select("week", F.lit("done").alias("status")).distinct()
    return rules.reminder_due(rows, status)


@query(
    "card_curriculum",
    """, n AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY number) AS sequence FROM library_documents)
    SELECT id, category, CAST(sequence AS INTEGER) AS sequence, CAST(least(5, (sequence - 1) // 20 + 1) AS INTEGER) AS level, CAST((sequence - 1) % 3 AS INTEGER) AS series FROM n""",
    ("library_documents",),
)
def card_curriculum(lib: Library) -> DataFrame:
    return rules.card_curriculum(lib.library_documents, "category", ["number"]).select("id", "category", "sequence", "level", "series")


@query("important_files", "SELECT repository, path FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY len(string_split(path, '/')), path) AS n FROM (SELECT primary_language AS repository, full_name AS path, stars * 5000 AS bytes FROM repositories) WHERE regexp_matches(path, '^(small|large)') AND bytes <= 200000) WHERE n <= 5", ("repositories",))
def important_files(lib: Library) -> DataFrame:
    files = lib.repositories.select(F.col("primary_language").alias("repository"), F.col("full_name").alias("path"), (F.col("stars") * 5000).alias("bytes"))
    return rules.important_files(files, "^(small|large)").select("repository", "path")


@query("valid_titles", r"SELECT id, CASE WHEN length(trim(regexp_replace(title, '[\s\x0B]+', ' ', 'g'))) BETWEEN 1 AND 60 THEN trim(regexp_replace(title, '[\s\x0B]+', ' ', 'g')) END AS title FROM library_documents", ("library_documents",))
def valid_titles(lib: Library) -> DataFrame:
    return lib.library_documents.select("id", rules.valid_title(F.col("title"), 60).alias("title"))


@query("derive_card_title", "SELECT id, substr(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], 1, 42) AS title FROM library_documents", ("library_documents",))
def derive_card_title(lib: Library) -> DataFrame:
    return lib.library_documents.select("id", rules.card_title(F.col("body")).alias("title"))


@query(
    "next_schedule",
    """, d AS (SELECT seq, ts, date_trunc('day', ts) + INTERVAL 9 HOUR AS today, (3 - (isodow(ts) - 1) + 7) % 7 AS ahead FROM ticks)
    SELECT seq, CAST(CASE WHEN today > ts THEN today ELSE today + INTERVAL 1 DAY END AS VARCHAR) AS daily,
           CAST(CASE WHEN today + to_days(CAST(ahead AS INTEGER)) > ts THEN today + to_days(CAST(ahead AS INTEGER)) ELSE today + to_days(CAST(ahead AS INTEGER) + 7) END AS VARCHAR) AS weekly FROM d""",
    ("ticks",),
)
def next_schedule(lib: Library) -> DataFrame:
    moment = F.col("ts").cast("timestamp")
    return lib.ticks.select("seq", rules.next_run(moment, 9).alias("daily"), rules.next_run(moment, 9, 3).alias("weekly"))


@query(
    "attach_job_location",
    f""", {TREE}, l AS (SELECT target_type, target_id, path FROM content_folders JOIN tree ON id = folder_id)
    SELECT j.id, coalesce(l.path, '') AS path FROM jobs j LEFT JOIN l ON l.target_type = 'document' AND l.target_id = j.target_id""",
    ("folders", "content_folders", "jobs"),
)
def attach_job_location(lib: Library) -> DataFrame:
    rows = lib.jobs.withColumn("target_type", F.lit("document"))
    return rules.attach_location(rows, lib.content_folders, hierarchy.folder_paths(lib.folders)).select("id", "path")


@query(
    "restore_columns_guarded",
    """SELECT id, 'same' AS bodies, CASE WHEN number % 2 = 0 THEN concat('was ', title) ELSE title END AS title FROM library_articles
    UNION ALL SELECT id, 'changed', title FROM library_articles""",
    ("library_articles",),
)
def restore_columns_guarded(lib: Library) -> DataFrame:
    """From an older version with the bodies of today, and from one in which the body of the
    newest article was another: nothing may be restored from that."""
    now = lib.library_articles.select("id", "number", "title", "body")
    older = now.where("number % 2 = 0").withColumn("title", F.concat(F.lit("was "), "title"))
    last = older.agg(F.max("number").alias("last"))
    other = older.join(F.broadcast(last)).withColumn("body", F.when(F.col("number") == F.col("last"), F.concat("body", F.lit("x"))).otherwise(F.col("body"))).drop("last")
    found = [rules.restore_guarded(now, o.drop("number"), "id", "body", ["title"]).select("id", F.lit(name).alias("bodies"), "title") for name, o in (("same", older), ("changed", other))]
    return found[0].unionByName(found[1])


@query("html_blocks")
def html_blocks(lib: Library) -> DataFrame:
    return articles.html_blocks(lib.pages)


@query("pages_to_articles")
def pages_to_articles(lib: Library) -> DataFrame:
    return articles.pages_to_articles(lib.pages)

