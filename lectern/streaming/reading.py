"""Reading activity and jobs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lectern.sources.shared import shared_path
from lectern.streaming.fold import Fold, path_exists


def stream_of(spark: SparkSession, path: str, files: int = 1, size: int | None = None) -> DataFrame:
    """A table's files as a stream, some files a batch, or files of `size` bytes (one at least);
    the table may be one file."""
    limit = ("maxBytesPerTrigger", size) if size else ("maxFilesPerTrigger", files)
    return spark.readStream.schema(spark.read.parquet(path).schema).option(*limit).parquet(f"{path}*")


def settled(stream: DataFrame, name: str, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over what is there, and read its last table (complete), all that it wrote
    (append), or of each key what it wrote last (update). A batch writes its own folder, so
    that one that is tried again writes nothing twice."""
    spark = stream.sparkSession
    out, marks = shared_path(spark, name), shared_path(spark, f"{name}-marks")
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={'0' if mode == 'complete' else batch}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True)
    writer.foreachBatch(put).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", out).parquet(out)
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, *(f"last.{c}" for c in rest))
    return rows.select(*stream.columns)


def daily_activity(events: DataFrame, out: str, marks: str, late: str = "2 days", most: int = 20) -> None:
    """events(owner_id, ts, value) as they come: seconds of each owner and day, a tick counting
    its rounded value, `most` at most. The mark of a batch is the latest time of those before
    it, less `late`; rows under it go to a table of late rows, so every row is in one of the
    two. A batch writes its own folders and its latest time, and reads those of earlier
    batches only: one that is tried again changes nothing."""
    spark = events.sparkSession
    times = "batch long, latest timestamp"

    def put(rows: DataFrame, number: int) -> None:
        earlier = spark.read.schema(times).parquet(f"{out}/latest/*").where(F.col("batch") < number)
        mark = earlier.agg(F.max("latest").alias("latest")).select((F.col("latest") - F.expr(f"interval {late}")).alias("mark"))
        told = rows.withColumn("at", F.col("ts").cast("timestamp")).join(F.broadcast(mark))  # one row
        told = told.withColumn("late", F.coalesce(F.col("at") < F.col("mark"), F.lit(False)))
        told.where("late").drop("at", "mark", "late").write.mode("overwrite").parquet(f"{out}/late/batch={number}")
        seconds = F.least(F.greatest(F.round("value").cast("long"), F.lit(0)), F.lit(most))
        days = told.where("NOT late").groupBy("owner_id", F.to_date("at").alias("local_day")).agg(F.count("*").alias("ticks"), F.sum(seconds).alias("seconds"))
        days.write.mode("overwrite").parquet(f"{out}/days/batch={number}")
        told.agg(F.max("at").alias("latest")).select(F.lit(number).cast("long").alias("batch"), "latest").write.mode("overwrite").parquet(f"{out}/latest/batch-{number}")

    if not path_exists(spark, f"{out}/latest"):
        spark.createDataFrame([], times).write.parquet(f"{out}/latest/none")
    events.writeStream.foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def days_of(spark: SparkSession, out: str) -> DataFrame:
    """What daily_activity() has counted."""
    rows = spark.read.parquet(f"{out}/days/*")
    return rows.groupBy("owner_id", "local_day").agg(F.sum("ticks").alias("ticks"), F.sum("seconds").alias("seconds"))


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows that came too late for daily_activity()."""
    return spark.read.parquet(f"{out}/late/*")


def sessions(events: DataFrame, gap: str = "2 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of each owner that no event can change any more: owner_id, started_at,
    last_active_at, ticks. A session ends `gap` after its last event and is given out, and
    forgotten, when the watermark is beyond that; open ones are state."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    made = rows.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("ticks"), F.max("at").alias("last_active_at"))
    return made.select(F.col("user_id").alias("owner_id"), F.col("w.start").alias("started_at"), "last_active_at", "ticks")


def session_parts(events: DataFrame, out: str, marks: str, gap: str = "2 minutes") -> None:
    """events(user_id, ts) as they come: the sessions that the rows of a batch make by
    themselves. No mark sets rows apart, so late ones are in; a batch that is tried again
    writes the same folder."""
    spark = events.sparkSession

    def put(rows: DataFrame, number: int) -> None:
        sessions(rows, gap).write.mode("overwrite").parquet(f"{out}/batch={number}")

    if not path_exists(spark, out):
        sessions(spark.createDataFrame([], events.schema), gap).write.parquet(f"{out}/batch=-1")
    events.writeStream.foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def sessions_of(spark: SparkSession, out: str, gap: str = "2 minutes") -> DataFrame:
    """What session_parts() has found, put together: parts of an owner that are no more than
    `gap` apart are one session, whatever their batches. Those that are open are given, too."""
    order = Window.partitionBy("owner_id").orderBy("started_at", "last_active_at")
    before = F.max("last_active_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("started_at") > before + F.expr(f"interval {gap}"), F.lit(False))
    rows = spark.read.parquet(out).withColumn("new", new).withColumn("session", F.sum(F.col("new").cast("int")).over(order))
    made = rows.groupBy("owner_id", "session").agg(F.min("started_at").alias("started_at"), F.max("last_active_at").alias("last_active_at"), F.sum("ticks").alias("ticks"))
    return made.drop("session")


def reading_days(spark: SparkSession, out: str, most_seconds: int = 86_400) -> Fold:
    """Cumulative totals (session_id, seq, local_day, total) -> increments (local_day, seconds).
    A session's state is its largest total so far, so repeated and late lower totals add
    nothing; no total counts beyond a day's seconds."""

    def step(state: tuple | None, row: tuple) -> tuple:
        before, total = state[0] if state else 0, min(row[2], most_seconds)
        return (max(before, total),), (row[1], total - before) if total > before else None

    return Fold(spark, out, "session_id", ["seq", "local_day", "total"], ["seq"], "local_day string, seconds long", "most long", step)


#: The states that may follow a state of a job.
FOLLOWS = {"": ("queued", "running"), "queued": ("running", "failed"), "running": ("completed", "failed", "queued"), "failed": ("queued",), "completed": ()}


def job_states(spark: SparkSession, out: str, every: bool = True) -> Fold:
    """Events of jobs (job_id, seq, status, progress) -> every event with the job's progress,
    attempts and retries after it and whether it was legal: its status may follow the job's,
    or reports the progress of a running job, and it comes after what is known. Illegal
    events change nothing. current() has the jobs, illegal_events() the side table; without
    `every` these two are all that is written."""

    def step(state: tuple | None, row: tuple) -> tuple:
        status, last, progress, attempts, retries = state or ("", -1, 0, 0, 0)
        seq, new, told = row
        legal = seq > last and new in FOLLOWS.get(status, ())
        if legal:
            attempts += new == "running"
            retries = 0 if (status, new) == ("failed", "queued") else retries + ((status, new) == ("running", "queued"))
            progress = 100 if new == "completed" else max(progress, 1) if new == "running" else 0 if (status, new) == ("failed", "queued") else progress
            status, last = new, seq
        elif seq > last and new == status == "running":  # a report, no change
            progress, last, legal = min(max(told or 0, 0), 99), seq, True
        return (status, last, progress, attempts, retries), (seq, new, progress, attempts, retries, legal) if every or not legal else None

    made = "seq long, status string, progress int, attempts int, retries int, legal boolean"
    return Fold(spark, out, "job_id", ["seq", "status", "progress"], ["seq", "status"], made, "status string, seq long, progress int, attempts int, retries int", step)


def illegal_events(jobs: Fold) -> DataFrame:
    return jobs.results().where("NOT legal").drop("legal")


def captures(spark: SparkSession, out: str) -> Fold:
    """Captured pages (url, html, captured_at, hash) -> those that are not older than the url's
    last and differ from it. A url's state is the hash and time of its last capture and the
    time of its first: a page that returns to an earlier form has changed again."""

    def step(state: tuple | None, row: tuple) -> tuple:
        html, at, own = row
        last, when, first = state or (None, None, at)
        first = min(first, at)
        if when is not None and at < when:
            return (last, when, first), None
        return (own, at, first), (html, at, own) if own != last else None

    return Fold(spark, out, "url", ["html", "captured_at", "hash"], ["captured_at", "hash"], "html string, captured_at timestamp, hash string", "hash string, captured_at timestamp, first_seen timestamp", step)


def hashed(pages: DataFrame) -> DataFrame:
    """pages(url, html, captured_at) with the hash of what was captured."""
    return pages.select("url", "html", F.col("captured_at").cast("timestamp").alias("captured_at"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("hash"))


def current_captures(taken: Fold) -> DataFrame:
    """A row a url: the newest form, when it was first captured in that form since it last
    changed, and when the url was first taken in."""
    newest = F.max_by(F.struct("html", "captured_at", "hash"), "captured_at").alias("x")
    first = taken.current().select("url", "first_seen")
    return taken.results().groupBy("url").agg(newest).select("url", "x.*").join(first, "url")
