"""Structure of articles: scope, figures, chapters from outlines, profiles."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapse_blanks, detect_language, summary
from lectern.operators.articles import blocks_of


def paper_scope(blocks: DataFrame, least: int = 1000, section: int = 120) -> DataFrame:
    """Block rows of papers -> abstract_only, fulltext (enough text and two sections that
    hold some) or unknown."""
    order = Window.partitionBy("page_id").orderBy("pos")
    w = blocks.withColumn("part", F.sum(F.col("tag").rlike("^h[1-6]$").cast("int")).over(order))
    parts = w.groupBy("page_id", "part").agg(F.sum(F.when(~F.col("tag").rlike("^h[1-6]$"), F.length("text")).otherwise(0)).alias("chars"))
    pages = parts.groupBy("page_id").agg(F.sum("chars").alias("chars"), F.count_if((F.col("part") > 0) & (F.col("chars") >= section)).alias("sections"))
    return pages.withColumn("scope", F.when((F.col("chars") >= least) & (F.col("sections") >= 2), "fulltext").when(F.col("chars") > 0, "abstract_only").otherwise("unknown"))


def restore_figures(article: DataFrame, source: DataFrame) -> DataFrame:
    """article(page_id, caption, src) without image get that of the source's figure of equal
    caption; images that the article has already aren't used again."""
    key = lambda c: F.lower(collapse_blanks(c))
    have = article.where("src IS NOT NULL").select("page_id", "src")
    free = source.join(have, ["page_id", "src"], "left_anti").groupBy("page_id", key(F.col("caption")).alias("key")).agg(F.min("src").alias("found"))
    rows = article.withColumn("key", key(F.col("caption"))).join(free, ["page_id", "key"], "left")
    return rows.select("page_id", "caption", F.coalesce("src", "found").alias("src"))


def merge_images_by_position(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """images(page_id, src, n): before the n-th text block; blocks(page_id, pos, text) and
    images in one order."""
    order = Window.partitionBy("page_id").orderBy("pos")
    text = blocks.withColumn("n", F.row_number().over(order)).select("page_id", "n", F.lit(1).alias("after"), F.col("text"), F.lit(None).cast("string").alias("src"))
    rows = text.unionByName(images.select("page_id", "n", F.lit(0).alias("after"), F.lit(None).cast("string").alias("text"), "src"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy("n", "after", "src"))).select("page_id", "pos", "text", "src")


def repair_table_spans(cells: DataFrame) -> DataFrame:
    """cells(table_id, row, col, span): spans within 1 to 20; a lone cell of a row spans as
    many cells as the next row has."""
    per_row = cells.groupBy("table_id", "row").agg(F.count("*").alias("cells"))
    following = F.lead("cells").over(Window.partitionBy("table_id").orderBy("row"))
    rows = cells.join(per_row.withColumn("following", following), ["table_id", "row"])
    span = F.greatest(F.lit(1), F.least(F.lit(20), F.coalesce("span", F.lit(1))))
    return rows.select("table_id", "row", "col", F.when((F.col("cells") == 1) & (F.col("following") > 1), F.least(F.col("following"), F.lit(20)).cast("int")).otherwise(span).alias("span"))


def outline_chapters(outline: DataFrame) -> DataFrame:
    """outline(doc_id, place, title, page) -> chapters with first and last page: the longest
    run of entries whose pages don't fall, one document at a time."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("place", ignore_index=True)
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(f)
        for i, page in enumerate(f["page"]):
            at = bisect_left(tails, page + 1)
            back[i] = ends[at - 1] if at else -1
            tails[at : at + 1], ends[at : at + 1] = [page], [i]
        keep, i = [], ends[-1] if ends else -1
        while i >= 0:
            keep.append(i)
            i = back[i]
        kept = f.loc[keep[::-1]].reset_index(drop=True)
        after = kept["page"].shift(-1)
        kept["last_page"] = (after - 1).where(after.notna(), kept["page"]).clip(lower=kept["page"]).astype("int32")
        return kept[["doc_id", "place", "title", "page", "last_page"]]

    return outline.select("doc_id", "place", "title", "page").groupBy("doc_id").applyInPandas(run, "doc_id string, place int, title string, page int, last_page int")


def markdown_to_article(chapters: DataFrame, least: int = 180) -> DataFrame:
    """chapters(id, title, text) in Markdown -> articles with text, summary and language;
    those shorter than `least` are left out."""
    t = F.regexp_replace("text", r"(?s)```.*?```", " ")
    for pattern, to in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^[ \t]*[-*+]\s+", ""), (r"[*_`~]+", "")):
        t = F.regexp_replace(t, pattern, to)
    rows = chapters.select("id", "title", F.trim(F.regexp_replace(t, "\n{3,}", "\n\n")).alias("body")).where(F.length("body") >= least)
    return rows.select("id", "title", "body", summary(F.col("body")).alias("summary"), detect_language(F.col("body")).alias("language"))


def resolve_chapter_link(base: Column, href: Column) -> Column:
    """Absolute url of a chapter's relative link; null for absolute ones and those that
    leave the base."""
    clean = F.regexp_replace(F.regexp_replace(href, r"[?#].*$", ""), r"^\./", "")
    bad = clean.rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:|//)") | clean.rlike(r"(^|/)\.\.(/|$)") | (clean == "")
    return F.when(~bad, F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(clean, "^/+", "")))


def recommend_folder(title: Column, route: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The folder of the first (word, folder) rule whose word title or route holds."""
    text = F.lower(F.concat_ws(" ", title, route))
    found = None
    for word, folder in rules:
        found = (F.when if found is None else found.when)(text.contains(word), folder)
    return F.coalesce(found, F.lit(default)) if found is not None else F.lit(default)


def transcript_article(segments: DataFrame) -> DataFrame:
    """segments(video_id, start, text) -> text in order, summary, language, number."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda s: s["text"]), " ")
    rows = segments.groupBy("video_id").agg(text.alias("text"), F.count("*").alias("segments"))
    return rows.select("video_id", "text", summary(F.col("text"), 320).alias("summary"), detect_language(F.col("text")).alias("language"), "segments")


def repository_profile(files: DataFrame, stacks: list[tuple[str, str]], most: int = 12) -> DataFrame:
    """files(repository, path, bytes) -> files, bytes, largest directories, and the stacks
    whose (name, pattern) a path matches."""
    top = F.when(F.col("path").contains("/"), F.split("path", "/")[0])
    sizes = files.where(top.isNotNull()).groupBy("repository", top.alias("dir")).agg(F.count("*").alias("n"))
    best = Window.partitionBy("repository").orderBy(F.col("n").desc(), "dir")
    dirs = sizes.withColumn("k", F.row_number().over(best)).where(F.col("k") <= most).groupBy("repository").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "dir"))), lambda x: x["dir"]), ",").alias("dirs"))
    flags = [F.bool_or(F.col("path").rlike(p)).alias(f"s{i}") for i, (_, p) in enumerate(stacks)]
    rows = files.groupBy("repository").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), *flags)
    names = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"s{i}"), n) for i, (n, _) in enumerate(stacks)))), ",")
    return rows.join(dirs, "repository", "left").select("repository", "files", "bytes", F.coalesce("dirs", F.lit("")).alias("dirs"), names.alias("stack"))


def split_oversize(lines: DataFrame, most: int = 4000) -> DataFrame:
    """lines(id, pos, text) packed to parts of `most` characters; each part starts with the
    page mark that holds for its first line."""
    order = Window.partitionBy("id").orderBy("pos")
    mark = F.last(F.when(F.col("text").rlike(r"^\[page [0-9]+\]$"), F.col("text")), ignorenulls=True).over(order)
    used = F.sum(F.length("text") + 1).over(order)
    # parts by the running size: a line belongs to the part in which it ends
    rows = lines.withColumn("mark", mark).withColumn("part", F.floor((used - 1) / most))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    packed = rows.groupBy("id", "part").agg(F.min_by("mark", "pos").alias("mark"), text.alias("text"))
    return packed.select("id", "part", F.when(F.col("mark").isNotNull() & ~F.col("text").startswith(F.col("mark")), F.concat("mark", F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"))


def note_plain_text(notes: DataFrame, most: int = 100_000) -> DataFrame:
    """notes(id, html) -> text: blocks as lines, images as their alternative text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text = ["\n".join(f"[{t}]" if tag == "img" else t for tag, _, t, *_ in blocks_of(h or ""))[:most] for h in f["html"]]
            yield pd.DataFrame({"id": f["id"], "text": text})

    return notes.select("id", "html").mapInPandas(run, "id string, text string")
