"""Streams over the event table, run to its end; what batch queries say is held against
them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.registry import query
from lectern.sources.library import Library
from lectern.sources.shared import shared_path
from lectern.streaming import reading


@query(
    "stream_daily_activity",
    "SELECT user_id AS owner_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS local_day, count(*) AS ticks, CAST(sum(least(greatest(CAST(round(value) AS BIGINT), 0), 20)) AS BIGINT) AS seconds FROM events GROUP BY ALL",
)
def stream_daily_activity(lib: Library) -> DataFrame:
    """Rows that came too late are counted from their own table, so that all rows are in."""
    out, marks = shared_path(lib.spark, "daily"), shared_path(lib.spark, "daily-marks")
    events = reading.stream_of(lib.spark, f"{lib.sf_dir}/events.parquet").select(F.col("user_id").alias("owner_id"), "ts", "value")
    reading.daily_activity(events, out, marks)
    seconds = F.least(F.greatest(F.round("value").cast("long"), F.lit(0)), F.lit(20))
    late = reading.late_rows(lib.spark, out).select("owner_id", F.to_date("ts").alias("local_day"), F.lit(1).cast("long").alias("ticks"), seconds.alias("seconds"))
    return reading.days_of(lib.spark, out).unionByName(late).groupBy("owner_id", "local_day").agg(F.sum("ticks").alias("ticks"), F.sum("seconds").alias("seconds"))


@query(
    "stream_sessions",
    """, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY owner_id ORDER BY ts, seq) > INTERVAL 12 HOUR AS new FROM ticks),
    n AS (SELECT *, sum(CAST(coalesce(new, false) AS INTEGER)) OVER (PARTITION BY owner_id ORDER BY ts, seq) AS session FROM g),
    s AS (SELECT owner_id, session, count(*) AS ticks FROM n GROUP BY ALL)
    SELECT owner_id, count(*) AS sessions, CAST(sum(ticks) AS BIGINT) AS ticks FROM s GROUP BY owner_id""",
    ("ticks",),
)
def stream_sessions(lib: Library) -> DataFrame:
    """Sessions of all events, open ones and those of late events too. Events of this table are
    hours apart, so the gap is longer than the two minutes of readers."""
    out, marks = shared_path(lib.spark, "sessions"), shared_path(lib.spark, "sessions-marks")
    reading.session_parts(reading.stream_of(lib.spark, f"{lib.sf_dir}/events.parquet"), out, marks, "12 hours")
    found = reading.sessions_of(lib.spark, out, "12 hours")
    return found.groupBy("owner_id").agg(F.count("*").alias("sessions"), F.sum("ticks").alias("ticks"))


#: Bytes of files in a batch of job events: each batch meets the states of its keys, so few are cheaper than a file each.
BATCH = 512 << 20
JOB_EVENTS = """
    SELECT CAST(l_orderkey AS VARCHAR(20)) AS job_id, CAST(2 * (l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey) AS BIGINT) AS seq, 'running' AS status, CAST(l_quantity AS INTEGER) AS progress FROM lineitem
    UNION ALL
    SELECT CAST(l_orderkey AS VARCHAR(20)), CAST(2 * (l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey) + 1 AS BIGINT), CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'queued' END, 0 FROM lineitem"""


@query(
    "stream_job_state",
    f""", e AS ({JOB_EVENTS}), o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM e),
    s AS (
      SELECT job_id, n, seq, status, CASE WHEN status = 'running' THEN 1 ELSE 0 END AS progress, CASE WHEN status = 'running' THEN 1 ELSE 0 END AS attempts, 0 AS retries, true AS legal FROM o WHERE n = 1
      UNION ALL
      SELECT job_id, n, CASE WHEN legal THEN next ELSE seq END, CASE WHEN legal THEN new ELSE status END,
             CASE WHEN NOT legal THEN progress WHEN new = 'completed' THEN 100 WHEN new = 'running' AND status = 'running' THEN least(greatest(told, 0), 99) WHEN new = 'running' THEN greatest(progress, 1) WHEN status = 'failed' THEN 0 ELSE progress END,
             attempts + CASE WHEN legal AND new = 'running' AND status <> 'running' THEN 1 ELSE 0 END,
             CASE WHEN legal AND status = 'failed' THEN 0 WHEN legal AND status = 'running' AND new = 'queued' THEN retries + 1 ELSE retries END, legal
      FROM (
        SELECT s.job_id, o.n, s.seq, o.seq AS next, s.status, o.status AS new, s.progress, o.progress AS told, s.attempts, s.retries,
               coalesce(CASE s.status WHEN 'queued' THEN o.status IN ('running', 'failed') WHEN 'running' THEN o.status IN ('completed', 'failed', 'queued', 'running') WHEN 'failed' THEN o.status = 'queued' ELSE false END, false) AS legal
        FROM s JOIN o ON o.job_id = s.job_id AND o.n = s.n + 1
      )
    )
    SELECT job_id, arg_max(seq, n) AS seq, arg_max(status, n) AS status, CAST(arg_max(progress, n) AS INTEGER) AS progress, CAST(arg_max(attempts, n) AS INTEGER) AS attempts, CAST(arg_max(retries, n) AS INTEGER) AS retries,
           count(*) FILTER (WHERE NOT legal) AS illegal FROM s GROUP BY job_id""",
    ("ticks",),
)
def stream_job_state(lib: Library) -> DataFrame:
    """The attempts of jobs as events, a start and an outcome each, in the order of their
    lines and, where numbers repeat, of part and supplier."""
    out, marks = shared_path(lib.spark, "jobs"), shared_path(lib.spark, "jobs-marks")
    lines = reading.stream_of(lib.spark, f"{lib.sf_dir}/lineitem.parquet", size=BATCH)
    outcome = F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "R", "failed").otherwise("queued")
    seq = 2 * (F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey").cast("long") * 1_000_000 + F.col("l_suppkey").cast("long"))
    both = F.explode(F.array(F.struct(seq.alias("seq"), F.lit("running").alias("status"), F.col("l_quantity").cast("int").alias("progress")), F.struct((seq + 1).alias("seq"), outcome.alias("status"), F.lit(0).alias("progress"))))
    jobs = reading.job_states(lib.spark, out, every=False)
    jobs.run(lines.select(F.col("l_orderkey").cast("string").alias("job_id"), both.alias("e")).select("job_id", "e.*"), marks)
    illegal = reading.illegal_events(jobs).groupBy("job_id").agg(F.count("*").alias("illegal"))
    return jobs.current().join(illegal, "job_id", "left").fillna(0, ["illegal"])


CAPTURES = """
    SELECT regexp_extract(url, '^[^?#]*', 0) AS url, html, page_id FROM {pages}"""


@query(
    "stream_captures",
    f""", c AS (SELECT *, TIMESTAMP '2024-01-01' + to_minutes(CAST(page_id AS INTEGER)) AS captured_at FROM ({CAPTURES.format(pages="pages")}))
    SELECT url, sha256(arg_max(html, captured_at)) AS hash, CAST(max(captured_at) AS VARCHAR) AS captured_at, CAST(min(captured_at) AS VARCHAR) AS first_seen FROM c GROUP BY url""",
    ("library_articles",),
)
def stream_captures(lib: Library) -> DataFrame:
    """Pages as captures of their address without its query. No two captures of an address
    that follow each other are equal here, so its newest is its last."""
    out, marks = shared_path(lib.spark, "captures"), shared_path(lib.spark, "captures-marks")
    pages = reading.stream_of(lib.spark, f"{lib.sf_dir}/pages.parquet")
    at = F.timestamp_seconds(1704067200 + 60 * F.col("page_id"))
    taken = reading.captures(lib.spark, out)
    taken.run(reading.hashed(pages.select(F.regexp_extract("url", "^[^?#]*", 0).alias("url"), "html", at.alias("captured_at"))), marks)
    return reading.current_captures(taken).select("url", "hash", "captured_at", "first_seen")


@query(
    "stream_reading_days",
    """, u AS (SELECT owner_id AS session_id, seq, CAST(ts AS DATE) AS local_day, CAST(least(greatest(floor(value), 0), 86400) AS BIGINT) AS total FROM ticks),
    m AS (SELECT *, max(total) OVER (PARTITION BY session_id ORDER BY seq) AS most, coalesce(max(total) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
    SELECT session_id, CAST(local_day AS VARCHAR) AS local_day, CAST(sum(most - before) AS BIGINT) AS seconds FROM m GROUP BY ALL HAVING sum(most - before) > 0""",
    ("ticks",),
)
def stream_reading_days(lib: Library) -> DataFrame:
    events = reading.stream_of(lib.spark, f"{lib.sf_dir}/events.parquet")
    updates = events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.to_date("ts").cast("string").alias("local_day"), F.greatest(F.floor("value").cast("long"), F.lit(0)).alias("total"))
    days = reading.reading_days(lib.spark, shared_path(lib.spark, "reading-days"))
    days.run(updates, shared_path(lib.spark, "reading-days-marks"))
    return days.results().groupBy("session_id", "local_day").agg(F.sum("seconds").alias("seconds"))
