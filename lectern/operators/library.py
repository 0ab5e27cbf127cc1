"""Lists, gates and requests over a library's items."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import HAN, collapse_blanks, first_nonblank, literal_contains, text_corruption, title_key

KEYS = ["target_type", "target_id"]


def content_summary(items: DataFrame, most: int = 220) -> DataFrame:
    """Shown title (the id if there is none) and summary (the title if there is none)."""
    title = first_nonblank(F.col("title"), F.col("target_id"))
    return items.select(*KEYS, title.alias("title"), F.substring(first_nonblank(F.col("summary"), title), 1, most).alias("summary"))


def join_hits(items: DataFrame, *hits: DataFrame) -> DataFrame:
    """Items that any of the hit lists names, once."""
    found = hits[0].select(*KEYS)
    for h in hits[1:]:
        found = found.unionByName(h.select(*KEYS))
    return items.join(found.distinct(), KEYS)


def list_papers(papers: DataFrame, placed: DataFrame, folder_ids: DataFrame | None, query: str, order: list, size: int) -> DataFrame:
    """First page of papers in given folders (None: those without any) whose text holds
    the query."""
    rows = papers.where(literal_contains(F.concat_ws(" ", "title", "body"), query)) if query else papers
    own = placed if folder_ids is None else placed.join(folder_ids, "folder_id", "left_semi")
    rows = rows.join(own.select(*KEYS), KEYS, "left_anti" if folder_ids is None else "left_semi")
    return rows.orderBy(*order).limit(size)


def counts_with_zeros(groups: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Members of each group, zero too."""
    return groups.join(members.groupBy(key).agg(F.count("*").alias("items")), key, "left").select(*groups.columns, F.coalesce("items", F.lit(0)).alias("items"))


def topic_items(members: DataFrame, items: DataFrame, tags: DataFrame) -> DataFrame:
    """Items of topics with their tags; members that name none are dropped."""
    own = members.join(items.select(*KEYS, "title", "updated_at"), KEYS)
    listed = tags.join(own.select(*KEYS), KEYS, "left_semi").groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_set("tag_name")), ",").alias("tags"))
    return own.join(listed, KEYS, "left").withColumn("tags", F.coalesce("tags", F.lit("")))


def duplicate_articles(incoming: DataFrame, library: DataFrame, least: int = 80) -> DataFrame:
    """incoming(id, url, title, body) against library(..., updated_at): same url, else same
    title key, else same text of `least` characters and more; the earliest item."""
    keys = {"url": F.col("url"), "title": F.nullif(title_key(F.col("title")), F.lit("")), "content": F.when(F.length("body") >= least, F.sha2("body", 256))}
    found, left = None, incoming.select("id", *(k.alias(f"k_{n}") for n, k in keys.items()))
    old = library.select(F.col("id").alias("match_id"), "updated_at", *(k.alias(f"k_{n}") for n, k in keys.items()))
    for n in keys:
        first = old.where(F.col(f"k_{n}").isNotNull()).groupBy(f"k_{n}").agg(F.min(F.struct("updated_at", "match_id"))["match_id"].alias("match_id"))
        hit = left.join(first, f"k_{n}").select("id", F.lit(n).alias("reason"), "match_id")
        found = hit if found is None else found.unionByName(hit.join(found, "id", "left_anti"))
    return found


def backfill(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """Rows whose stored value isn't what it should be, with the right one."""
    return rows.withColumn("_new", value).where(~F.col("_new").eqNullSafe(F.col(column))).drop(column).withColumnRenamed("_new", column)


def translation_need(language: Column) -> Column:
    return F.when(language.isin("en", "mixed"), "not_requested").otherwise("not_required")


def needs_ocr(extension: Column, text: Column) -> Column:
    """Images, and PDF files with hardly any text or a broken text layer."""
    thin = F.length(F.trim(F.coalesce(text, F.lit("")))) < 80
    return extension.isin("png", "jpg", "jpeg", "webp", "tif", "tiff", "bmp") | ((extension == "pdf") & (thin | text_corruption(text)))


def prose_language_gate(text: Column, least: int = 40, share: float = 0.7) -> Column:
    """Enough Han characters, also against the number of Latin words?"""
    han, words = F.regexp_count(text, F.lit(HAN)), F.regexp_count(text, F.lit("[A-Za-z]{2,}"))
    return (han >= least) & (han >= share * words)


def translation_requests(items: DataFrame, force: bool = False) -> DataFrame:
    """items(id, status, progress) that may be queued: not running, and not ready unless
    forced; queued ones start anew."""
    can = (F.col("status") != "running") & (F.lit(force) | (F.col("status") != "ready"))
    return items.where(can).withColumn("status", F.lit("queued")).withColumn("progress", F.lit(0).cast("long"))


def progress(value: Column, status: Column) -> Column:
    """1 to 99 while running, 100 when done, else 0."""
    return F.when(status == "completed", 100).when(status == "running", F.greatest(F.lit(1), F.least(F.lit(99), F.coalesce(F.floor(value), F.lit(1))))).otherwise(0).cast("long")


def valid_cards(cards: DataFrame, kinds: list[str], default: str) -> DataFrame:
    """Cards with front and back; an unknown kind becomes the default."""
    full = F.coalesce(F.trim("front") != "", F.lit(False)) & F.coalesce(F.trim("back") != "", F.lit(False))
    return cards.where(full).withColumn("kind", F.when(F.col("kind").isin(kinds), F.col("kind")).otherwise(default))


def retry_outcome(failed: DataFrame, transient: Column, attempts: Column, most: int) -> DataFrame:
    """What a failed job does next: retry while it may (2 to 8 attempts), else stop."""
    limit = min(8, max(2, most))
    return failed.withColumn("outcome", F.when(transient & (attempts < limit), "retry").otherwise("terminal"))


def storage_usage(snapshots: DataFrame) -> DataFrame:
    """snapshots(kind, path, made_at, bytes): files, bytes and newest of each kind."""
    return snapshots.groupBy("kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.max(F.struct("made_at", "path"))["path"].alias("newest"))


def owner_snapshot(tables: dict[str, DataFrame], owner: int) -> dict[str, DataFrame]:
    """Every table's rows of one owner."""
    return {name: rows.where(F.col("owner_id") == owner) for name, rows in tables.items()}


def locate_selection(selections: DataFrame, items: DataFrame) -> DataFrame:
    """selections(id, quote) with the quote's place in the item's text, from 0; those that
    aren't there are dropped."""
    met = selections.join(items.select("id", "body"), "id").withColumn("offset", F.expr("locate(quote, body)").cast("long") - 1)
    return met.where("offset >= 0").drop("body")


def paragraphs_to_html(text: Column) -> Column:
    """Blocks between empty lines as escaped paragraphs."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    blocks = F.filter(F.transform(F.split(escaped, "\n\\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(blocks, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "\n")


def markdown_export(items: DataFrame, notes: DataFrame) -> DataFrame:
    """(target_type, target_id, markdown): title, category and notes of each item in order."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("updated_at", "note_text"))), lambda n: F.concat(F.lit("> "), n["note_text"])), "\n")
    own = notes.groupBy(*KEYS).agg(listed.alias("notes"))
    rows = items.join(own, KEYS, "left")
    return rows.select(*KEYS, F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("*"), "category", F.lit("*")), "notes").alias("markdown"))


def merge_chunk_titles(entries: DataFrame) -> DataFrame:
    """entries(id, pos, title): following entries whose titles differ only in "(i/n)" as
    one, with their range."""
    bare = collapse_blanks(F.regexp_replace("title", r"[(（][0-9]+/[0-9]+[)）]\s*$", ""))
    order = Window.partitionBy("id").orderBy("pos")
    rows = entries.withColumn("title", bare)
    rows = rows.withColumn("run", F.sum(F.coalesce((F.lag("title").over(order) != F.col("title")).cast("int"), F.lit(1))).over(order))
    return rows.groupBy("id", "run", "title").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("parts")).drop("run")


def readable_lines(lines: DataFrame) -> DataFrame:
    """lines(id, pos, text): a bullet that stands alone is joined to the line after it."""
    order = Window.partitionBy("id").orderBy("pos")
    alone = F.trim("text").rlike(r"^([-*•·]|[0-9]{1,2}[.)])$")
    last = F.lag("text").over(order)
    joined = F.coalesce(F.trim(last).rlike(r"^([-*•·]|[0-9]{1,2}[.)])$"), F.lit(False))
    return lines.withColumn("new", F.when(joined, F.concat(F.trim(last), F.lit(" "), F.trim("text"))).otherwise(F.trim("text"))).where(~alone).select("id", "pos", F.col("new").alias("text"))


def chunk_overlap(items: DataFrame, size: int = 1200, overlap: int = 120, least: int = 40, search: float = 0.65) -> DataFrame:
    """items(id, body) -> chunks that end, if they can, at a paragraph, a full stop or a semicolon
    in their last third. Trimmed chunks of fewer than `least` characters are left out, but
    count. Where a chunk begins depends on where the one before ended, so a text is cut in
    one go, inside its task."""

    def cuts(text: str) -> Iterator[tuple[int, int, int, str]]:
        start, n = 0, 0
        while start < len(text):
            end, n = min(len(text), start + size), n + 1
            if end < len(text):
                low = start + int(size * search)
                at = max(text.rfind(mark, low, end) for mark in ("\n\n", "。", "；", ". "))
                end = at + 1 if at >= 0 else end
            if len(part := text[start:end].strip(" \t\n\r")) >= least:
                yield n, start, end, part
            if end >= len(text):
                break
            start = max(start + 1, end - overlap)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for first in range(0, len(f), 500):
                part = f[first : first + 500]
                rows = [(f"{i}-C{n}", i, s, e, t) for i, body in zip(part["id"], part["body"], strict=True) for n, s, e, t in cuts(body or "")]
                yield pd.DataFrame(rows, columns=["chunk_id", "id", "start", "stop", "text"])

    return items.select("id", "body").mapInPandas(run, "chunk_id string, id string, start long, stop long, text string")
