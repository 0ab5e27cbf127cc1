"""Notes and what can be said of them in short."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import literal_contains, summary
from lectern.operators.maintenance import Snapshots
from lectern.operators.ranks import ranked
from lectern.operators.search import paged
from lectern.sources.shared import settle


#: Headings of a note's form, which say nothing, and what marks questions and actions.
HEADINGS = r"^(核心问题|我的理解|证据与局限|下一步行动)$"
QUESTION, ACTION = r"[?？]|^(为什么|如何|是否|疑问|问题)", r"(?i)(下一步|待办|TODO|行动|尝试|验证|补充|复现|阅读)"


def note_lines(notes: DataFrame) -> DataFrame:
    """notes(target_id, turn, note_text) -> lines of three characters and more, without marks of
    headings and lists."""
    lines = notes.select("target_id", "turn", F.posexplode(F.split("note_text", "\r?\n")).alias("pos", "line"))
    clean = F.col("line")
    for mark in (r"^#{1,6}\s*", r"^[-*+]\s+", r"^[0-9]+[.)、]\s*"):
        clean = F.regexp_replace(clean, mark, "")
    return lines.withColumn("line", F.trim(clean)).where((F.length("line") >= 3) & ~F.col("line").rlike(HEADINGS))


def digest_points(notes: DataFrame, keys: int = 10, others: int = 8, per_note: int = 2, size: int = 180) -> DataFrame:
    """notes(target_id, turn, note_text, updated_at) -> (kind, n, target_id, turn, text): the first
    lines of notes, questions and actions, each in the order of the notes up to a number."""
    lines = note_lines(notes).join(notes.select("target_id", "turn", "updated_at"), ["target_id", "turn"])
    own = Window.partitionBy("target_id", "turn").orderBy("pos")
    order = ["updated_at", "target_id", "turn", "pos"]
    found = None
    for kind, rows, most in (
        ("key", lines.withColumn("own", F.row_number().over(own)).where(F.col("own") <= per_note), keys),
        ("question", lines.where(F.col("line").rlike(QUESTION)), others),
        ("action", lines.where(F.col("line").rlike(ACTION)), others),
    ):
        first = rows.orderBy(*order).limit(most)  # a few rows, numbered in one task
        part = first.select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(*order)).alias("n"), "target_id", "turn", summary(F.col("line"), size).alias("text"))
        found = part if found is None else found.unionByName(part)
    return found


def digest_themes(notes: DataFrame, none: str = "unsorted") -> DataFrame:
    """notes(target_id, category, note_text) -> (theme, notes, sources), and a row for all of them."""
    kept = notes.where(F.trim("note_text") != "").withColumn("theme", F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(none)))
    themes = kept.groupBy("theme").agg(F.count("*").alias("notes"), F.count_distinct("target_id").alias("sources"))
    whole = kept.agg(F.lit("(all)").alias("theme"), F.count("*").alias("notes"), F.count_distinct("target_id").alias("sources"))
    return themes.unionByName(whole)


def digest_overview(notes: DataFrame, none: str = "未分类") -> DataFrame:
    """notes(target_type, target_id, category, note_text) -> one row: notes, sources, themes and
    what is said of them."""
    kept = notes.where(F.trim("note_text") != "")
    theme = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(none))
    rows = kept.agg(F.count("*").alias("notes"), F.count_distinct("target_type", "target_id").alias("sources"), F.count_distinct(theme).alias("themes"))
    said = F.format_string("本期整理了 %d 条笔记，来自 %d 份资料，归入 %d 个主题。", "notes", "sources", "themes")
    return rows.withColumn("overview", F.when(F.col("notes") > 0, said).otherwise("本期没有需要整理的新笔记。"))


def digest_sources(notes: DataFrame, none: str = "未分类") -> DataFrame:
    """(theme, place, theme_notes, target_type, target_id, title): themes from the fullest, each
    with its sources once."""
    theme = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(none))
    kept = notes.where(F.trim("note_text") != "").withColumn("theme", theme)
    counts = kept.groupBy("theme").agg(F.count("*").alias("theme_notes"))
    places = ranked(counts, [], [F.col("theme_notes").desc(), F.col("theme")], "place")
    sources = kept.groupBy("theme", "target_type", "target_id").agg(F.min("title").alias("title"))
    return sources.join(places, "theme").select("theme", "place", "theme_notes", "target_type", "target_id", "title")


def list_all_notes(reading: DataFrame, own: DataFrame, content: DataFrame, annotations: DataFrame, query: str = "", kind: str = "", after: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """Notes on items and notes of their own in one list, newest first, one page with the number
    of all and whether more follow.

    reading: target_type, target_id, note_text, updated_at; own: note_type, id, title,
    content_text, updated_at; content: target_type, target_id, title, category; annotations:
    target_type, target_id, quote_text, note_text. A note on an item is found by its text,
    the item's title or category, if the item is there and the note isn't blank; a note of
    its own by title or text. kind is a target or note type, else no filter. Annotations
    that say something are counted for the page's items."""
    keys, query = ["target_type", "target_id"], query.strip()
    met = reading.where(F.trim("note_text") != "").join(content.select(*keys, F.col("title").alias("_title"), F.col("category").alias("_category")), keys)
    found = met.where(literal_contains(F.concat_ws(" ", "note_text", F.coalesce("_title", F.lit("")), F.coalesce("_category", F.lit(""))), query)) if query else met
    mine = own.where(F.col("note_type").isin("markdown", "text", "word"))
    mine = mine.where(literal_contains(F.concat_ws(" ", "title", "content_text"), query)) if query else mine
    named = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    rows = found.select(*keys, named("_title", "未命名资料").alias("title"), named("_category", "未分类").alias("category"), "updated_at", F.lit(False).alias("own"))
    rows = rows.unionByName(mine.select(F.col("note_type").alias("target_type"), F.col("id").alias("target_id"), "title", F.lit(None).cast("string").alias("category"), "updated_at", F.lit(True).alias("own")))
    if kind:
        rows = rows.where(F.col("target_type") == kind)
    if after:
        rows = rows.where(F.col("updated_at") > F.lit(after).cast("timestamp_ntz"))
    page = settle(paged(rows, [F.col("updated_at").desc(), "target_id", "target_type"], limit, offset, 5000), "notes-page")
    said = (F.trim(F.coalesce("quote_text", F.lit(""))) != "") | (F.trim(F.coalesce("note_text", F.lit(""))) != "")
    counts = annotations.where(said).join(F.broadcast(page.where("NOT own").select(*keys).distinct()), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("_n"))  # a page
    return page.join(counts, keys, "left").select("place", *keys, "title", "category", "updated_at", F.when(F.col("own"), 0).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("annotations"), "total", "has_more")


def note_digest(notes: DataFrame) -> DataFrame:
    """Per item: notes, lines, questions and the first line."""
    lines = note_lines(notes)
    asked = F.col("line").rlike(QUESTION)
    return lines.groupBy("target_id").agg(F.count_distinct("turn").alias("notes"), F.count("*").alias("lines"), F.count_if(asked).alias("questions"), F.min_by("line", F.struct("turn", "pos")).alias("first_line"))


def list_notes(notes: DataFrame, query: str, k: int) -> DataFrame:
    """Notes that hold the query, newest first."""
    return notes.where(literal_contains(F.col("note_text"), query)).orderBy(F.col("updated_at").desc(), "target_id").limit(k)


def note_library_summary(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count("*").alias("notes"), F.count_distinct("target_id").alias("items"), F.max("updated_at").alias("latest"))


def key_points(notes: DataFrame, k: int = 2) -> DataFrame:
    """The first k lines of each item's notes."""
    order = Window.partitionBy("target_id").orderBy("turn", "pos")
    return note_lines(notes).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("target_id", "n", "line")


def incremental(notes: DataFrame, mark: str) -> DataFrame:
    """Notes changed after the mark of the last run."""
    return notes.where(F.col("updated_at") > F.expr(f"timestamp_ntz'{mark}'"))


class Digests:
    """Digests of the notes that changed since the last run, and the mark up to which notes have
    been taken in. Digest and mark become known with one pointer: a run that fails moves
    neither, and the next takes its notes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.runs = spark, Snapshots(spark, path)

    def mark(self) -> str | None:
        return self.runs.note()

    def run(self, notes: DataFrame, until: str) -> DataFrame | None:
        """notes(target_id, turn, note_text, updated_at) changed after the mark and not after
        `until`, blank ones left out -> digest: per item notes, lines, questions, first line,
        period. None if there are none; the mark moves all the same. Nothing to be done if
        the mark is there already."""
        since = self.mark()
        end = F.lit(until).cast("timestamp_ntz")
        fresh = notes.where((F.trim("note_text") != "") & (F.col("updated_at") <= end))
        if since is not None:
            if since >= until:
                return None
            fresh = fresh.where(F.col("updated_at") > F.lit(since).cast("timestamp_ntz"))
        changed = fresh.groupBy("target_id").agg(F.count("*").alias("notes"))
        lines = note_digest(fresh).drop("notes")
        digest = changed.join(lines, "target_id", "left").select("target_id", "notes", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("questions", F.lit(0)).alias("questions"), "first_line", F.lit(since).cast("string").alias("period_start"), F.lit(until).alias("period_end"))
        version = self.runs.publish(digest, note=until)
        made = self.spark.read.schema(digest.schema).parquet(f"{self.runs.path}/data/{version}")
        return made if made.head(1) else None

    def digests(self) -> DataFrame:
        """All digests of all runs."""
        names = [r.version for r in self.runs.versions().select("version").collect()]
        return self.spark.read.parquet(*(f"{self.runs.path}/data/{n}" for n in names))
