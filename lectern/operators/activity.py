"""Reading time and what dashboards show of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))


def heartbeat_seconds(ticks: DataFrame, most: int = 20, idle: int = 120) -> DataFrame:
    """ticks(owner_id, ts, seq) with `seconds`: the time since the owner's last tick, at
    most `most`; 0 after an idle time and for the first tick."""
    last = F.lag("ts").over(Window.partitionBy("owner_id").orderBy("ts", "seq"))
    gap = seconds_between(last, F.col("ts"))
    return ticks.withColumn("seconds", F.when(gap <= idle, F.least(gap, F.lit(most))).otherwise(0).cast("long"))


def split_midnight(spans: DataFrame) -> DataFrame:
    """spans(key, started_at, ended_at) -> (key, local_day, seconds), one row a day."""
    days = F.explode(F.sequence(F.to_date("started_at"), F.to_date("ended_at")))
    rows = spans.select("key", "started_at", "ended_at", days.alias("local_day"))
    begin = F.greatest(F.col("started_at"), F.col("local_day").cast("timestamp_ntz"))
    end = F.least(F.col("ended_at"), F.date_add("local_day", 1).cast("timestamp_ntz"))
    return rows.select("key", "local_day", seconds_between(begin, end).cast("long").alias("seconds")).where("seconds > 0")


def reading_sessions(ticks: DataFrame, gap_hours: int = 12, progress: str | None = None) -> DataFrame:
    """Sessions of each owner: ticks with no longer pause than gap_hours. With a column of
    progress, what it was at the first and the last tick, 0 to 100."""
    order = Window.partitionBy("owner_id").orderBy("ts", "seq")
    new = (seconds_between(F.lag("ts").over(order), F.col("ts")) > gap_hours * 3600).cast("int")
    numbered = ticks.withColumn("session", F.sum(F.coalesce(new, F.lit(0))).over(order).cast("long"))
    seconds = F.least(seconds_between(F.min("ts"), F.max("ts")), F.lit(86_400)).cast("long")
    shown = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(100))
    ends = [] if progress is None else [shown(f(progress, F.struct("ts", "seq"))).alias(name) for f, name in ((F.min_by, "progress_start"), (F.max_by, "progress_end"))]
    return numbered.groupBy("owner_id", "session").agg(*ends, F.min("ts").alias("started_at"), F.max("ts").alias("last_active_at"), F.count("*").alias("ticks"), seconds.alias("active_seconds"), F.count_distinct("target_id").alias("items"))


def cumulative_day_deltas(updates: DataFrame) -> DataFrame:
    """updates(session_id, seq, local_day, total): cumulative totals -> seconds of each day.
    Repeated and lower totals add nothing."""
    order = Window.partitionBy("session_id").orderBy("seq")
    most = F.max("total").over(order)
    before = F.coalesce(F.max("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return updates.select("session_id", "local_day", (most - before).alias("delta")).groupBy("session_id", "local_day").agg(F.sum("delta").cast("long").alias("seconds")).where("seconds > 0")


def session_days(ticks: DataFrame, most: int = 20, idle: int = 120) -> DataFrame:
    """Active seconds of each owner, item and day, from heartbeats."""
    rows = heartbeat_seconds(ticks, most, idle)
    return rows.groupBy("owner_id", "target_id", F.to_date("ts").alias("local_day")).agg(F.sum("seconds").alias("active_seconds"))


def calendar_days(spark: SparkSession, first_day: str, days: int) -> DataFrame:
    """The days of a range of 1 to 365, as local_day."""
    return spark.range(min(365, max(1, days))).select(F.date_add(F.lit(first_day).cast("date"), F.col("id").cast("int")).alias("local_day"))


def daily_activity(read: DataFrame, added: DataFrame, first_day: str, days: int) -> DataFrame:
    """A row for each day of the calendar: active seconds and items of read(target_id, local_day,
    active_seconds), and how many items of each kind added(target_type, local_day) brought;
    zeros where nothing was."""
    kinds = ("document", "article", "paper")
    per_day = read.groupBy("local_day").agg(F.sum("active_seconds").alias("active_seconds"), F.count_distinct("target_id").alias("items"))
    new = added.groupBy("local_day").agg(*(F.count_if(F.col("target_type") == k).alias(f"{k}s") for k in kinds))
    rows = calendar_days(read.sparkSession, first_day, days).join(per_day, "local_day", "left").join(new, "local_day", "left")
    return rows.select("local_day", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("active_seconds", "items", *(f"{k}s" for k in kinds))))


def activity_summary(read: DataFrame, states: DataFrame, added: DataFrame, first_day: str, days: int) -> DataFrame:
    """One row for a range of days: active seconds, items whose reading state changed, days with
    reading, items added, and when reading began at all."""
    end = F.date_add(F.lit(first_day).cast("date"), min(365, max(1, days)))
    within = lambda day: (day >= F.lit(first_day).cast("date")) & (day < end)
    inside = read.where(within(F.col("local_day"))).agg(F.coalesce(F.sum("active_seconds"), F.lit(0)).alias("active_seconds"), F.count_distinct("local_day").alias("active_days"))
    changed = states.where(within(F.to_date("updated_at"))).agg(F.count_distinct("target_type", "target_id").alias("read_items"))
    new = added.where(within(F.col("local_day"))).agg(F.count("*").alias("new_items"))
    since = read.agg(F.min("local_day").alias("since"))
    return inside.join(F.broadcast(changed)).join(F.broadcast(new)).join(F.broadcast(since))


def progress_buckets(states: DataFrame) -> DataFrame:
    """All four states of progress with their numbers, zeros too."""
    p = F.coalesce(F.col("progress"), F.lit(0))
    bucket = F.when(p >= 95, "completed").when(p >= 75, "almost").when(p > 0, "reading").otherwise("unread")
    names = states.sparkSession.createDataFrame([("unread",), ("reading",), ("almost",), ("completed",)], "bucket string")
    return names.join(states.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def recent_reading(states: DataFrame, content: DataFrame, k: int = 12) -> DataFrame:
    """The items read last, with how many read them and how far they came."""
    per_item = states.groupBy("target_type", "target_id").agg(F.max("updated_at").alias("last_read"), F.count("*").alias("readers"), F.max("progress").alias("progress"))
    return per_item.join(content.select("target_type", "target_id", "title"), ["target_type", "target_id"]).orderBy(F.col("last_read").desc(), "target_type", "target_id").limit(k)


def completion_rate(states: DataFrame, least: int = 95) -> DataFrame:
    """Share of an owner's items that are done."""
    return states.groupBy("owner_id").agg(F.count("*").alias("items"), F.count_if(F.col("progress") >= least).alias("done"), F.round(F.avg((F.col("progress") >= least).cast("double")), 6).alias("rate"))


def backfill_session_days(sessions: DataFrame, days: DataFrame) -> DataFrame:
    """Sessions without a day's row get all seconds on their last active day."""
    return sessions.join(days, "session_id", "left_anti").select("session_id", F.to_date("last_active_at").alias("local_day"), "active_seconds")
