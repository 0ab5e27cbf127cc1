"""Reading activity, jobs and review cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import activity, jobs
from lectern.plans.registry import query
from lectern.sources.library import Library

EPOCH = "epoch(date_trunc('second', {}))"


@query(
    "heartbeat_seconds",
    """, g AS (SELECT owner_id, seq, CAST(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY owner_id ORDER BY ts, seq))) AS BIGINT) AS gap FROM ticks)
    SELECT owner_id, seq, CASE WHEN gap <= 36000 THEN least(gap, 1800) ELSE 0 END AS seconds FROM g""",
    ("ticks",),
)
def heartbeat_seconds(lib: Library) -> DataFrame:
    return activity.heartbeat_seconds(lib.ticks, 1800, 36_000).select("owner_id", "seq", "seconds")


SESSIONS = """
    g AS (SELECT *, epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY owner_id ORDER BY ts, seq))) > 43200 AS new FROM ticks),
    n AS (SELECT *, CAST(sum(CAST(coalesce(new, false) AS INTEGER)) OVER (PARTITION BY owner_id ORDER BY ts, seq) AS BIGINT) AS session FROM g),
    sessions AS (
      SELECT owner_id, session, min(ts) AS started_at, max(ts) AS last_active_at, count(*) AS ticks, count(DISTINCT target_id) AS items,
             CAST(least(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))), 86400) AS BIGINT) AS active_seconds,
             least(100, greatest(0, arg_min(value, (ts, seq)))) AS progress_start, least(100, greatest(0, arg_max(value, (ts, seq)))) AS progress_end FROM n GROUP BY owner_id, session
    )"""


@query("reading_sessions", f", {SESSIONS} SELECT owner_id, session, ticks, items, active_seconds, progress_start, progress_end, CAST(started_at AS DATE)::VARCHAR AS first_day FROM sessions", ("ticks",))
def reading_sessions(lib: Library) -> DataFrame:
    return activity.reading_sessions(lib.ticks, progress="value").select("owner_id", "session", "ticks", "items", "active_seconds", "progress_start", "progress_end", F.to_date("started_at").alias("first_day"))


@query(
    "split_midnight",
    f""", {SESSIONS}, d AS (SELECT *, unnest(generate_series(CAST(started_at AS DATE), CAST(last_active_at AS DATE), INTERVAL 1 DAY)) AS day FROM sessions)
    , s AS (SELECT owner_id, session, CAST(CAST(day AS DATE) AS VARCHAR) AS local_day,
        CAST(epoch(date_trunc('second', least(last_active_at, day + INTERVAL 1 DAY))) - epoch(date_trunc('second', greatest(started_at, day))) AS BIGINT) AS seconds FROM d)
    SELECT concat(owner_id, '-', session) AS key, local_day, seconds FROM s WHERE seconds > 0""",
    ("ticks",),
)
def split_midnight(lib: Library) -> DataFrame:
    spans = activity.reading_sessions(lib.ticks).select(F.concat_ws("-", "owner_id", "session").alias("key"), "started_at", F.col("last_active_at").alias("ended_at"))
    return activity.split_midnight(spans)


@query(
    "cumulative_day_deltas",
    """, u AS (SELECT owner_id AS session_id, seq, CAST(ts AS DATE) AS local_day, CAST(floor(value) AS BIGINT) AS total FROM ticks),
    m AS (SELECT *, max(total) OVER (PARTITION BY session_id ORDER BY seq) AS most, coalesce(max(total) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
    SELECT session_id, CAST(local_day AS VARCHAR) AS local_day, CAST(sum(greatest(most, 0) - greatest(before, 0)) AS BIGINT) AS seconds FROM m GROUP BY ALL HAVING sum(greatest(most, 0) - greatest(before, 0)) > 0""",
    ("ticks",),
)
def cumulative_day_deltas(lib: Library) -> DataFrame:
    updates = lib.ticks.select(F.col("owner_id").alias("session_id"), "seq", F.to_date("ts").alias("local_day"), F.greatest(F.floor("value").cast("long"), F.lit(0)).alias("total"))
    return activity.cumulative_day_deltas(updates)


READ = """
    g AS (SELECT *, CAST(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY owner_id ORDER BY ts, seq))) AS BIGINT) AS gap FROM ticks),
    read AS (SELECT owner_id, target_id, CAST(ts AS DATE) AS local_day, CAST(sum(CASE WHEN gap <= 36000 THEN least(gap, 1800) ELSE 0 END) AS BIGINT) AS active_seconds FROM g GROUP BY ALL),
    added AS (SELECT target_type, CAST(updated_at AS DATE) AS local_day FROM content)"""


def read_and_added(lib: Library) -> tuple[DataFrame, DataFrame]:
    return activity.session_days(lib.ticks, 1800, 36_000), lib.content.select("target_type", F.to_date("updated_at").alias("local_day"))


@query("session_days", f", {READ} SELECT owner_id, target_id, CAST(local_day AS VARCHAR) AS local_day, active_seconds FROM read", ("ticks", "content"))
def session_days(lib: Library) -> DataFrame:
    return read_and_added(lib)[0]


@query(
    "daily_activity",
    f""", {READ}, days AS (SELECT CAST(d AS DATE) AS local_day FROM generate_series(DATE '2023-12-20', DATE '2023-12-20' + 59, INTERVAL 1 DAY) t(d)),
    r AS (SELECT local_day, sum(active_seconds) AS active_seconds, count(DISTINCT target_id) AS items FROM read GROUP BY 1),
    a AS (SELECT local_day, count(*) FILTER (WHERE target_type = 'document') AS documents, count(*) FILTER (WHERE target_type = 'article') AS articles, count(*) FILTER (WHERE target_type = 'paper') AS papers FROM added GROUP BY 1)
    SELECT CAST(local_day AS VARCHAR) AS local_day, CAST(coalesce(active_seconds, 0) AS BIGINT) AS active_seconds, coalesce(items, 0) AS items, coalesce(documents, 0) AS documents, coalesce(articles, 0) AS articles, coalesce(papers, 0) AS papers
    FROM days LEFT JOIN r USING (local_day) LEFT JOIN a USING (local_day)""",
    ("ticks", "content"),
)
def daily_activity(lib: Library) -> DataFrame:
    return activity.daily_activity(*read_and_added(lib), "2023-12-20", 60)


@query(
    "activity_summary",
    f""", {READ} SELECT CAST(sum(active_seconds) AS BIGINT) AS active_seconds, count(DISTINCT local_day) AS active_days,
      (SELECT count(DISTINCT (target_type, target_id)) FROM reading_states WHERE CAST(updated_at AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-15') AS read_items,
      (SELECT count(*) FROM added WHERE local_day BETWEEN DATE '2024-01-01' AND DATE '2024-01-15') AS new_items, CAST((SELECT min(local_day) FROM read) AS VARCHAR) AS since
    FROM read WHERE local_day BETWEEN DATE '2024-01-01' AND DATE '2024-01-15'""",
    ("ticks", "content", "reading_states"),
)
def activity_summary(lib: Library) -> DataFrame:
    read, added = read_and_added(lib)
    return activity.activity_summary(read, lib.reading_states, added, "2024-01-01", 15)


@query(
    "progress_buckets",
    """, b(bucket) AS (VALUES ('unread'), ('reading'), ('almost'), ('completed'))
    SELECT bucket, count(p) AS n FROM b LEFT JOIN (SELECT progress AS p, CASE WHEN progress >= 95 THEN 'completed' WHEN progress >= 75 THEN 'almost' WHEN progress > 0 THEN 'reading' ELSE 'unread' END AS bucket FROM reading_states) USING (bucket) GROUP BY bucket""",
    ("reading_states",),
)
def progress_buckets(lib: Library) -> DataFrame:
    return activity.progress_buckets(lib.reading_states)


@query(
    "recent_reading",
    """SELECT target_type, target_id, title, CAST(max(s.updated_at) AS VARCHAR) AS last_read, count(*) AS readers, max(progress) AS progress FROM reading_states s JOIN content c USING (target_type, target_id)
    GROUP BY ALL ORDER BY max(s.updated_at) DESC, target_type, target_id LIMIT 12""",
    ("reading_states", "content"),
)
def recent_reading(lib: Library) -> DataFrame:
    return activity.recent_reading(lib.reading_states, lib.content)


@query("completion_rate", "SELECT owner_id, count(*) AS items, count(*) FILTER (WHERE progress >= 95) AS done, round(avg(CAST(progress >= 95 AS DOUBLE)), 6) AS rate FROM reading_states GROUP BY owner_id", ("reading_states",))
def completion_rate(lib: Library) -> DataFrame:
    return activity.completion_rate(lib.reading_states)


@query(
    "backfill_session_days",
    f""", {SESSIONS} SELECT concat(owner_id, '-', session) AS session_id, CAST(CAST(last_active_at AS DATE) AS VARCHAR) AS local_day, active_seconds FROM sessions WHERE session % 2 = 1""",
    ("ticks",),
)
def backfill_session_days(lib: Library) -> DataFrame:
    sessions = activity.reading_sessions(lib.ticks).withColumn("session_id", F.concat_ws("-", "owner_id", "session"))
    return activity.backfill_session_days(sessions, sessions.where("session % 2 = 0").select("session_id"))


@query("library_totals", "SELECT target_type, count(*) AS items, count(*) FILTER (WHERE (target_type, target_id) NOT IN (SELECT (target_type, target_id) FROM content_folders)) AS unfiled FROM content GROUP BY target_type", ("content", "content_folders"))
def library_totals(lib: Library) -> DataFrame:
    placed = lib.content_folders.select("target_type", "target_id").distinct().withColumn("filed", F.lit(1))
    return lib.content.join(placed, ["target_type", "target_id"], "left").groupBy("target_type").agg(F.count("*").alias("items"), F.count_if(F.col("filed").isNull()).alias("unfiled"))


@query(
    "job_current_state",
    """SELECT job_id, arg_max(outcome, (ts, seq, outcome)) AS outcome, CAST(max(ts) AS VARCHAR) AS ts, count(*) AS attempts, count(*) FILTER (WHERE outcome = 'R') AS failures FROM attempts GROUP BY job_id""",
    ("attempts",),
)
def job_current_state(lib: Library) -> DataFrame:
    return jobs.job_current_state(lib.attempts)


@query("latest_job_per_target", "SELECT target_id, id, job_type, status FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, number DESC) AS n FROM jobs) WHERE n = 1", ("jobs",))
def latest_job_per_target(lib: Library) -> DataFrame:
    return jobs.latest_per_target(lib.jobs).select("target_id", "id", "job_type", "status")


@query("queue_position", "SELECT id, job_type, row_number() OVER (PARTITION BY job_type ORDER BY created_at, number) AS position FROM jobs WHERE status = 'queued'", ("jobs",))
def queue_position(lib: Library) -> DataFrame:
    return jobs.queue_positions(lib.jobs)


@query("eligible_jobs", "SELECT id, job_type FROM jobs WHERE status = 'queued' AND job_type IN ('1-URGENT', '2-HIGH') AND created_at <= TIMESTAMP '1997-06-01 00:00:00' ORDER BY created_at, number LIMIT 50", ("jobs",))
def eligible_jobs(lib: Library) -> DataFrame:
    return jobs.eligible(lib.jobs, ["1-URGENT", "2-HIGH"], "1997-06-01 00:00:00", 50).select("id", "job_type")


@query("next_wake", "SELECT job_type, CAST(min(created_at) AS VARCHAR) AS at FROM jobs WHERE status = 'queued' AND created_at > TIMESTAMP '1997-06-01 12:00:00' GROUP BY job_type", ("jobs",))
def next_wake(lib: Library) -> DataFrame:
    return jobs.next_wake(lib.jobs, "1997-06-01 12:00:00")


@query("import_batch_summary", "SELECT job_type, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running, count(*) AS total FROM jobs GROUP BY job_type", ("jobs",))
def import_batch_summary(lib: Library) -> DataFrame:
    return jobs.batch_summary(lib.jobs)


@query(
    "stuck_jobs",
    "SELECT id, job_type, CAST(created_at AS VARCHAR) AS created_at FROM jobs WHERE status = 'running' AND id NOT IN (SELECT job_id FROM attempts WHERE outcome <> 'R')",
    ("jobs", "attempts"),
)
def stuck_jobs(lib: Library) -> DataFrame:
    done = lib.attempts.where("outcome <> 'R'").select(F.col("job_id").alias("id"))
    return lib.jobs.where("status = 'running'").join(done, "id", "left_anti").select("id", "job_type", "created_at")


@query("list_jobs", "SELECT id, status FROM jobs WHERE job_type = '3-MEDIUM' AND status = 'completed' ORDER BY created_at DESC, number DESC LIMIT 30", ("jobs",))
def list_jobs(lib: Library) -> DataFrame:
    return lib.jobs.where("job_type = '3-MEDIUM' AND status = 'completed'").orderBy(F.col("created_at").desc(), F.col("number").desc()).limit(30).select("id", "status")


@query("anti_missing_job", "SELECT id FROM library_documents WHERE id NOT IN (SELECT target_id FROM jobs)", ("library_documents", "jobs"))
def anti_missing_job(lib: Library) -> DataFrame:
    return lib.library_documents.join(lib.jobs.select(F.col("target_id").alias("id")), "id", "left_anti").select("id")


@query(
    "retry_classify",
    """, e AS (SELECT seq, CAST(400 + floor(value) % 230 AS INTEGER) AS status, (['Connection timed out', 'bad input', 'got HTTP 503 from source', 'HTTP 5030', 'getaddrinfo ENOTFOUND x', 'quota exceeded', 'token has expired'])[CAST(1 + seq % 7 AS INTEGER)] AS message FROM ticks)
    SELECT seq, status, status IN (408, 425, 429) OR (status >= 500 AND status <= 599) OR message IN ('Connection timed out', 'got HTTP 503 from source', 'getaddrinfo ENOTFOUND x') AS transient,
           CASE WHEN status = 402 OR message = 'quota exceeded' THEN 'quota' WHEN message = 'token has expired' THEN 'login' WHEN message IN ('Connection timed out', 'got HTTP 503 from source', 'getaddrinfo ENOTFOUND x') THEN 'network' END AS kind,
           CAST(CASE WHEN status = 402 OR message = 'quota exceeded' THEN 1800000 WHEN message IN ('token has expired', 'Connection timed out', 'got HTTP 503 from source', 'getaddrinfo ENOTFOUND x') THEN 60000 END AS INTEGER) AS delay_ms FROM e""",
    ("ticks",),
)
def retry_classify(lib: Library) -> DataFrame:
    said = F.array(*map(F.lit, ("Connection timed out", "bad input", "got HTTP 503 from source", "HTTP 5030", "getaddrinfo ENOTFOUND x", "quota exceeded", "token has expired")))
    rows = lib.ticks.select("seq", (F.lit(400) + F.pmod(F.floor("value"), F.lit(230))).cast("int").alias("status"), F.element_at(said, (F.col("seq") % 7 + 1).cast("int")).alias("message"))
    return rows.select("seq", "status", jobs.transient(F.col("status"), F.col("message")).alias("transient"), jobs.passing(F.when(F.col("status") == 402, jobs.USED_UP), F.col("message")).alias("p")).select("seq", "status", "transient", "p.kind", "p.delay_ms")


@query(
    "retry_after",
    """, r AS (SELECT job_id, seq, epoch_ms(CAST(ts AS TIMESTAMP)) - epoch_ms(TIMESTAMP '1995-06-17 00:00:00') AS ahead FROM attempts)
    SELECT job_id, seq, CASE seq % 4 WHEN 0 THEN greatest(1000, least(3600000, seq * 700500)) WHEN 1 THEN greatest(1000, least(3600000, ahead)) END AS wait_ms FROM r""",
    ("attempts",),
)
def retry_after(lib: Library) -> DataFrame:
    date = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    told = F.when(F.col("seq") % 4 == 0, (F.col("seq") * 700.5).cast("string")).when(F.col("seq") % 4 == 1, date).when(F.col("seq") % 4 == 2, "soon")
    return lib.attempts.select("job_id", "seq", jobs.retry_after(told, F.lit("1995-06-17 00:00:00").cast("timestamp")).alias("wait_ms"))


@query(
    "retry_delay",
    """SELECT job_id, CASE WHEN max(seq) % 3 = 0 THEN greatest(1000, least(3600000, CAST(max(seq) * 1000000 AS BIGINT))) ELSE CAST(([30000, 120000, 480000, 1800000])[greatest(1, least(4, CAST(count(*) AS INTEGER)))] AS BIGINT) END AS delay_ms FROM attempts GROUP BY job_id""",
    ("attempts",),
)
def retry_delay(lib: Library) -> DataFrame:
    rows = lib.attempts.groupBy("job_id").agg(F.count("*").alias("n"), F.max("seq").alias("seq"))
    told = jobs.retry_after(F.when(F.col("seq") % 3 == 0, (F.col("seq") * 1000).cast("string")), F.lit("2024-01-01").cast("timestamp"))
    return rows.select("job_id", jobs.retry_delay(F.col("n").cast("int"), told).alias("delay_ms"))


SCHEDULE = """
    r AS (SELECT card_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, rating, row_number() OVER (PARTITION BY card_id ORDER BY ts, seq) AS k, count(*) OVER (PARTITION BY card_id) AS total FROM reviews),
    s AS (
      SELECT card_id, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS days, CAST(2.5 AS DOUBLE) AS ease, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS last FROM (SELECT DISTINCT card_id FROM r)
      UNION ALL
      SELECT card_id, k, CASE WHEN fits THEN new ELSE days END, CASE WHEN fits THEN least(CAST(3.2 AS DOUBLE), greatest(CAST(1.3 AS DOUBLE), ease + step)) ELSE ease END, n + CAST(fits AS BIGINT), CASE WHEN fits THEN day ELSE last END
      FROM (
        SELECT *, new + day <= 100000000 AS fits FROM (
          SELECT s.card_id, r.k, s.days, s.ease, s.n, s.last, r.day, CASE r.rating WHEN 'again' THEN CAST(-0.2 AS DOUBLE) WHEN 'hard' THEN CAST(-0.05 AS DOUBLE) WHEN 'easy' THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS step,
                 CASE r.rating WHEN 'again' THEN CAST(1 AS DOUBLE) WHEN 'hard' THEN greatest(CAST(1 AS DOUBLE), floor(s.days * CAST(1.2 AS DOUBLE) + 0.5))
                   WHEN 'easy' THEN greatest(CAST(3 AS DOUBLE), floor((CASE WHEN s.days = 0 THEN 1 ELSE s.days END) * CAST(3 AS DOUBLE) + 0.5)) ELSE greatest(CAST(1 AS DOUBLE), floor((CASE WHEN s.days = 0 THEN 1 ELSE s.days END) * CAST(2.2 AS DOUBLE) + 0.5)) END AS new
          FROM s JOIN r ON r.card_id = s.card_id AND r.k = s.k + 1))
    ),
    cards AS (SELECT s.card_id, CAST(days AS BIGINT) AS days, round(ease, 6) AS ease, n AS reviews, last + CAST(days AS BIGINT) AS due FROM s JOIN (SELECT card_id, max(k) AS total FROM r GROUP BY card_id) t ON t.card_id = s.card_id AND t.total = s.k)"""


@query("review_schedule", f", {SCHEDULE} SELECT card_id, days, ease, reviews, due FROM cards", ("reviews",))
def review_schedule(lib: Library) -> DataFrame:
    return jobs.review_schedule(lib.reviews)


@query("review_load", f", {SCHEDULE} SELECT due, count(*) AS cards FROM cards GROUP BY ALL", ("reviews",))
def review_load(lib: Library) -> DataFrame:
    return jobs.review_load(jobs.review_schedule(lib.reviews))


@query("due_cards", f", {SCHEDULE} SELECT card_id, due FROM cards WHERE due <= date_diff('day', DATE '1970-01-01', DATE '2024-02-20') ORDER BY cards.due, card_id LIMIT 40", ("reviews",))
def due_cards(lib: Library) -> DataFrame:
    return jobs.due_cards(jobs.review_schedule(lib.reviews), "2024-02-20", 40).select("card_id", "due")


@query(
    "daily_rotation",
    """, c AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS size FROM library_papers), d AS (SELECT i, CAST(DATE '2024-01-01' + CAST(i AS INTEGER) AS VARCHAR) AS day FROM range(0, 400) t(i))
    SELECT id, day FROM d JOIN c ON i % size = place""",
    ("library_papers",),
)
def daily_rotation(lib: Library) -> DataFrame:
    return jobs.daily_rotation(lib.library_papers.select("id"), "2024-01-01", 400, "id")
