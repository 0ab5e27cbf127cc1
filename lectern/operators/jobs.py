"""Jobs and review cards: states from events, queues, retries, schedules."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ranks import ranked

#: Seconds before each next attempt.
LADDER = (30, 120, 480, 1800)
#: What the messages of passing failures say.
TRANSIENT = (
    r"(?i)ECONNRESET|ECONNREFUSED|ETIMEDOUT|EAI_AGAIN|ENOTFOUND|UND_ERR_|fetch failed|socket"
    r"|connection (?:reset|closed|timed out)|network (?:error|unreachable)"
    r"|HTTP\s*(?:408|425|429|5[0-9][0-9])\b|（(?:408|425|429|5[0-9][0-9])）"
)
#: Fixed values of the review schedule: factors of an interval, least intervals, steps of the ease,
#: its bounds and its first value; the last day that a calendar knows, from 1970.
FACTORS, LEAST, EASE_STEPS = {"hard": 1.2, "good": 2.2, "easy": 3.0}, {"hard": 1, "good": 1, "easy": 3}, {"again": -0.2, "hard": -0.05, "good": 0.0, "easy": 0.15}
EASE_BOUNDS, FIRST_EASE, LAST_DAY = (1.3, 3.2), 2.5, 100_000_000


def job_current_state(events: DataFrame) -> DataFrame:
    """events(job_id, seq, ts, outcome) -> last outcome and time, number of attempts."""
    return events.groupBy("job_id").agg(F.max_by("outcome", F.struct("ts", "seq", "outcome")).alias("outcome"), F.max("ts").alias("ts"), F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "R").alias("failures"))


def latest_per_target(jobs: DataFrame) -> DataFrame:
    """Of each target the newest job by (created_at, number)."""
    rest = [c for c in jobs.columns if c != "target_id"]
    last = F.max_by(F.struct(*rest), F.struct("created_at", "number")).alias("j")
    return jobs.groupBy("target_id").agg(last).select("target_id", *(F.col(f"j.{c}").alias(c) for c in rest))


def queue_positions(jobs: DataFrame) -> DataFrame:
    """Places from 1 among the queued jobs of a type, oldest first. Types are few and large."""
    queued = jobs.where("status = 'queued'").select("id", "job_type", "created_at", "number")
    return ranked(queued, ["job_type"], [F.col("created_at"), F.col("number")], "position").select("id", "job_type", "position")


def eligible(jobs: DataFrame, types: list[str], now: str, k: int) -> DataFrame:
    """Queued jobs of known types that are due, oldest first."""
    return jobs.where((F.col("status") == "queued") & F.col("job_type").isin(types) & (F.col("created_at") <= F.expr(f"timestamp_ntz'{now}'"))).orderBy("created_at", "number").limit(k)


def next_wake(jobs: DataFrame, now: str) -> DataFrame:
    """The earliest future time of each type's queued jobs."""
    return jobs.where((F.col("status") == "queued") & (F.col("created_at") > F.expr(f"timestamp_ntz'{now}'"))).groupBy("job_type").agg(F.min("created_at").alias("at"))


def batch_summary(jobs: DataFrame) -> DataFrame:
    """Jobs of each type by status."""
    return jobs.groupBy("job_type").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("completed", "queued", "running")), F.count("*").alias("total"))


def transient(status: Column, message: Column) -> Column:
    """Is a failure worth another attempt: a status of overload or of the server's side, or a
    message of a broken connection?"""
    return F.coalesce(status.isin(408, 425, 429) | status.between(500, 599), F.lit(False)) | F.coalesce(message.rlike(TRANSIENT), F.lit(False))


#: Messages of failures that pass, with their kind and how long to wait in
#: milliseconds, in the order in which they count; the code of a used-up limit.
USED_UP = "CODEX_USAGE_LIMIT"
PASSING = (
    ("quota", r"(?i)you(?:'|’)ve hit your usage limit|usage limit|purchase more credits|quota exceeded|insufficient_quota", 1_800_000),
    ("login", r"(?i)not logged in|authentication required|login required|token (?:has )?expired|unauthorized", 60_000),
    ("network", r"(?i)ECONNRESET|ETIMEDOUT|EAI_AGAIN|ENOTFOUND|connection (?:reset|timed out)|network (?:error|unreachable)|error sending request|stream disconnected|HTTP\s+(?:429|502|503|504)\b", 60_000),
)


def passing(code: Column, message: Column) -> Column:
    """struct(kind, delay_ms) of a failure of a service that will come back: quota, login or
    network; null for others. The code of a used-up limit counts without a message."""
    found = F.when(F.coalesce(code == USED_UP, F.lit(False)), F.struct(F.lit("quota").alias("kind"), F.lit(PASSING[0][2]).alias("delay_ms")))
    for kind, pattern, delay in PASSING:
        found = found.when(F.coalesce(message, F.lit("")).rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lit(delay).alias("delay_ms")))
    return found


def waiting_until(failures: DataFrame, now: Column) -> DataFrame:
    """failures(code, message, failed_at) -> one row: the latest end of a wait that is still
    ahead and its kind; none if nothing waits. A shorter wait never cuts a longer one."""
    rows = failures.select(passing(F.col("code"), F.col("message")).alias("p"), "failed_at").where("p IS NOT NULL")
    until = F.timestamp_millis(F.unix_millis(F.col("failed_at").cast("timestamp")) + F.col("p.delay_ms"))
    last = rows.select(until.alias("until"), F.col("p.kind").alias("kind")).agg(F.max(F.struct("until", "kind")).alias("x"))
    return last.select("x.*").where(F.col("until") > now)


def retry_after(told: Column, now: Column) -> Column:
    """Milliseconds that a Retry-After header asks for, 1 s to 1 h: it holds seconds or a date.
    Null if it says neither."""
    text = F.trim(told)
    seconds = text.try_cast("double")
    date = F.try_to_timestamp(F.regexp_extract(text, r"(?i)^(?:[a-z]{3,9},\s*)?([0-9]{1,2} [a-z]{3} [0-9]{4} [0-9:]{8})(?: GMT| UTC)?$", 1), F.lit("d MMM yyyy HH:mm:ss"))
    ahead = (F.unix_micros(date) - F.unix_micros(now.cast("timestamp"))) / 1000
    wait = F.when(seconds.isNotNull() & (seconds >= 0) & (seconds < float("inf")), seconds * 1000).otherwise(ahead)
    return F.when(wait.isNotNull(), F.greatest(F.lit(1_000), F.least(wait, F.lit(3_600_000))).cast("long"))


def retry_delay(attempt: Column, told_ms: Column | None = None) -> Column:
    """Milliseconds to wait: what retry_after() found, or the ladder's step."""
    step = F.element_at(F.array(*(F.lit(1000 * x) for x in LADDER)), F.greatest(F.lit(1), F.least(attempt, F.lit(len(LADDER)))).cast("int")).cast("long")
    return step if told_ms is None else F.coalesce(told_ms.cast("long"), step)


def reviewed(days: float, ease: float, n: int, day: int, rating: str) -> tuple[float, float, int]:
    """A card's (interval, ease, reviews) after one more review on that day (from 1970). A
    card without an interval grows from one day, but not after `hard`. A review whose
    due day no calendar knows fails and changes nothing."""
    rating = rating if rating in EASE_STEPS else "good"
    base = days if rating == "hard" else days or 1.0
    new = 1.0 if rating == "again" else max(float(LEAST[rating]), floor(base * FACTORS[rating] + 0.5))
    if day + new > LAST_DAY:
        return days, ease, n
    return new, min(EASE_BOUNDS[1], max(EASE_BOUNDS[0], ease + EASE_STEPS[rating])), n + 1


def review_schedule(reviews: DataFrame) -> DataFrame:
    """reviews(card_id, seq, ts, rating) folded in order: interval in days, ease, number of
    reviews, due day (from 1970). Unknown ratings count as good. Reviews are sorted by
    card and time; a task reads them as a stream and keeps one card's state."""
    card = reviews.schema["card_id"].dataType.simpleString()
    rows = reviews.select("card_id", "ts", "seq", F.unix_date(F.to_date("ts")).alias("day"), F.coalesce("rating", F.lit("")).alias("rating"))
    ordered = rows.repartition("card_id").sortWithinPartitions("card_id", "ts", "seq", "rating").select("card_id", "day", "rating")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, last, out = None, None, 0, []

        def made() -> pa.RecordBatch:
            cards, days, eases, counts, due = zip(*out, strict=True) if out else ((),) * 5
            return pa.RecordBatch.from_arrays([pa.array(cards, schema.field(0).type), pa.array(days, pa.float64()), pa.array(eases, pa.float64()), pa.array(counts, pa.int64()), pa.array(due, pa.int64())], names=["card_id", "days", "ease", "reviews", "due"])

        for b in batches:
            schema = b.schema
            for c, day, rating in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if state is None or c != own:
                    if state is not None:
                        out.append((own, *state, last + int(state[0])))
                    own, state, last = c, (0.0, FIRST_EASE, 0), day
                before, state = state, reviewed(*state, day, rating)
                last = day if state[2] > before[2] else last
            yield made()
            out = []
        if state is not None:
            out.append((own, *state, last + int(state[0])))
            yield made()

    folded = ordered.mapInArrow(fold, f"card_id {card}, days double, ease double, reviews long, due long")
    return folded.select("card_id", F.col("days").cast("long").alias("days"), F.round("ease", 6).alias("ease"), "reviews", "due")


def review_load(cards: DataFrame) -> DataFrame:
    """Cards due on each day."""
    return cards.groupBy("due").agg(F.count("*").alias("cards"))


def due_cards(cards: DataFrame, today: str, k: int) -> DataFrame:
    """Cards due by a day, the longest due first."""
    return cards.where(F.col("due") <= F.unix_date(F.lit(today).cast("date"))).orderBy("due", "card_id").limit(k)


def daily_rotation(items: DataFrame, first_day: str, days: int, order: str) -> DataFrame:
    """Which item of a catalogue each day shows: the day's offset modulo its size."""
    size = items.agg(F.count("*").alias("size"))
    calendar = items.sparkSession.range(days).select(F.col("id").alias("offset"), F.date_add(F.lit(first_day).cast("date"), F.col("id").cast("int")).alias("day"))
    # no more items are shown than there are days
    catalogue = items.orderBy(order).limit(days).withColumn("place", F.row_number().over(Window.orderBy(order)) - 1)
    wanted = calendar.join(F.broadcast(size)).select("day", F.pmod("offset", "size").alias("place"))
    return catalogue.join(F.broadcast(wanted), "place").drop("place")
