"""Files and markup as tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.sources.shared import settle

PLAIN = ("txt", "md", "csv", "tsv", "json", "log", "xml", "yaml", "yml")
PAGES = ("html", "htm")
OFFICE = {"docx": r"word/document\.xml$", "pptx": r"ppt/slides/slide\d+\.xml$", "xlsx": r"xl/(sharedStrings|worksheets/sheet\d+)\.xml$"}


def read_files_bytes(spark: SparkSession, path: str) -> DataFrame:
    """name, extension, size, sha256 and content of the files in a folder, empty ones left
    out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def file_text(extension: str, content: bytes) -> tuple[str, str]:
    """(text, status): complete, empty, unsupported or failed:<error>."""
    try:
        if extension in PLAIN:
            text = content.decode("utf-8", "replace")
        elif extension in PAGES:
            text = unescape(re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(script|style).*?</\1>", " ", content.decode("utf-8", "replace"))))
        elif extension in OFFICE:
            parts = []
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for n in sorted(archive.namelist()):
                    if re.search(OFFICE[extension], n):
                        for node in ElementTree.fromstring(archive.read(n)).iter():
                            tag = node.tag.rpartition("}")[2]
                            if tag == "t" and node.text:
                                parts.append(node.text)
                            elif tag in ("p", "si"):
                                parts.append("\n")
            text = "".join(parts)
        else:
            return "", "unsupported"
    except Exception as error:  # a broken file is a row, not a failed job
        return "", f"failed:{type(error).__name__}"
    text = text.strip()
    return text, "complete" if text else "empty"


def extract_file_text(files: DataFrame) -> DataFrame:
    """name, extension, text, status of each file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [file_text(e, bytes(c)) for e, c in zip(f["extension"], f["content"], strict=True)]
            yield pd.DataFrame({"name": f["name"], "extension": f["extension"], "text": [t for t, _ in found], "status": [s for _, s in found]})

    return files.select("name", "extension", "content").mapInPandas(run, "name string, extension string, text string, status string")


#: The columns of text items as a page reader gives them.
TEXT_ITEMS = "doc string, page int, x double, y double, width double, height double, str string"


def read_text_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Text items in JSON lines or Parquet -> (items, rejected lines). Items are in the columns
    of TEXT_ITEMS and have a place; those without are left out, widths and heights that are
    missing are 0, texts empty. A JSON line that isn't one, or whose values don't fit, is
    rejected whole, as text; Parquet files must have the columns, whose values are cast."""
    place, size = (F.col("x").isNotNull() & F.col("y").isNotNull()), ["width", "height"]
    if path.rstrip("/*").endswith(".parquet"):
        rows = spark.read.parquet(path)
        wanted = [c.split(" ") for c in TEXT_ITEMS.split(", ")]
        missing = [c for c, _ in wanted if c not in rows.columns]
        if missing:
            raise ValueError(f"columns that are missing: {missing}")
        items, bad = rows.select(*(F.col(c).try_cast(kind).alias(c) for c, kind in wanted)), spark.createDataFrame([], "line string")
    else:
        rows = spark.read.schema(f"{TEXT_ITEMS}, _line string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").json(path)
        rows = settle(rows, "text-items")  # parsed once; Spark refuses a scan for the rejected lines alone
        bad = rows.where(F.col("_line").isNotNull()).select(F.col("_line").alias("line"))
        items = rows.where(F.col("_line").isNull()).drop("_line")
    items = items.where(place & ~F.isnan("x") & ~F.isnan("y")).fillna(0.0, size).fillna("", ["str"])
    return items, bad


def read_ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Words of an OCR table: level 5, not blank, confidence 0 to 100."""
    rows = spark.read.option("sep", "\t").option("header", "true").option("quote", "").csv(path)
    numbers = ["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height"]
    missing = {*numbers, "conf", "text"} - {*rows.columns}
    if missing:
        raise ValueError(f"columns that are missing: {sorted(missing)}")
    words = rows.select(*(F.col(n).try_cast("int").alias(n) for n in numbers), F.col("conf").try_cast("double").alias("conf"), F.trim("text").alias("text"))
    return words.where("level = 5 AND text <> ''").withColumn("conf", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("conf", F.lit(0.0)))))


def caption_json3(payloads: DataFrame) -> DataFrame:
    """payloads(video_id, payload) -> (video_id, start, duration, text) in seconds."""
    kind = "struct<events: array<struct<tStartMs: double, dDurationMs: double, segs: array<struct<utf8: string>>>>>"
    event = F.explode(F.from_json("payload", kind)["events"])
    rows = payloads.select("video_id", event.alias("e"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), r"\s+", " "))
    return rows.select("video_id", (F.coalesce("e.tStartMs", F.lit(0.0)) / 1000).alias("start"), (F.coalesce("e.dDurationMs", F.lit(0.0)) / 1000).alias("duration"), text.alias("text")).where("text <> ''")


def caption_timedtext(payloads: DataFrame) -> DataFrame:
    """The same from XML captions: text with start and dur, or p with t and d in
    milliseconds."""
    tags = F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)(<(?:text|p)\s[^>]*>.*?</(?:text|p)>)"), F.lit(1)))
    rows = payloads.select("video_id", tags.alias("x"))
    number = lambda name: F.regexp_extract("x", rf'\s{name}="([0-9.]+)"', 1).try_cast("double")
    text = F.regexp_replace("x", "<[^>]*>", "")
    for entity, sign in (("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return rows.select("video_id", F.coalesce(number("start"), number("t") / 1000, F.lit(0.0)).alias("start"), F.coalesce(number("dur"), number("d") / 1000, F.lit(0.0)).alias("duration"), text.alias("text")).where("text <> ''")


def atom_entries(feeds: DataFrame) -> DataFrame:
    """feeds(payload) -> id without version, title, summary (4000 characters), published."""
    rows = feeds.select(F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("x"))
    field = lambda name: F.trim(F.regexp_replace(F.regexp_extract("x", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1), r"\s+", " "))
    return rows.select(F.regexp_replace(field("id"), r"v[0-9]+$", "").alias("id"), field("title").alias("title"), F.substring(field("summary"), 1, 4000).alias("summary"), field("published").alias("published")).where("id <> ''")


def abstract_page_metadata(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> url, title, abstract, authors from citation meta tags; pages
    without a title are left out."""
    meta = lambda name: F.regexp_extract_all("html", F.lit(rf'<meta\s+name="{name}"\s+content="([^"]*)"'), F.lit(1))
    first = lambda name: F.try_element_at(meta(name), F.lit(1))
    rows = pages.select("url", first("citation_title").alias("title"), F.substring(first("citation_abstract"), 1, 4000).alias("abstract"), meta("citation_author").alias("authors"), first("citation_date").alias("published"))
    return rows.where("title IS NOT NULL AND title <> ''")


def markdown_sidebar(sites: DataFrame, most: int = 200) -> DataFrame:
    """sites(site, sidebar) -> chapters of a nested list of links: order, depth, title, href,
    the group above; the first of equal hrefs, at most `most` a site."""
    lines = sites.select("site", F.posexplode(F.split("sidebar", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"^\s*[-*+]\s+"))
    link = r"\[([^\]]+)\]\(([^)\s]+)[^)]*\)"
    rows = lines.select("site", "pos", F.floor(F.length(F.regexp_extract("line", r"^(\s*)", 1)) / 2).cast("int").alias("depth"), F.regexp_extract("line", link, 1).alias("title"), F.regexp_extract("line", link, 2).alias("href"), F.trim(F.regexp_replace("line", r"^\s*[-*+]\s+|[*_`]", "")).alias("label"))
    order = Window.partitionBy("site").orderBy("pos")
    group = F.last(F.when(F.col("href") == "", F.col("label")), ignorenulls=True).over(order)
    rows = rows.withColumn("group", group).where("href <> ''")
    first = Window.partitionBy("site", "href").orderBy("pos")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("order", F.row_number().over(order))
    return rows.where(F.col("order") <= most).select("site", "order", "depth", "group", "title", "href")


def readme_chapters(sites: DataFrame, known: DataFrame) -> DataFrame:
    """Links of a readme that look like chapters and that the sidebar (site, href) lacks."""
    links = sites.select("site", F.explode(F.regexp_extract_all("readme", F.lit(r"(\[[^\]]+\]\([^)\s]+\.md\))"), F.lit(1))).alias("x"))
    rows = links.select("site", F.regexp_extract("x", r"\[([^\]]+)\]", 1).alias("title"), F.regexp_extract("x", r"\(([^)]+)\)", 1).alias("href"))
    return rows.dropDuplicates(["site", "href"]).join(known, ["site", "href"], "left_anti")


def markdown_table(pages: DataFrame, heading: str) -> DataFrame:
    """pages(page, text) -> rows (day, title, url, id) of the table under a heading."""
    section = F.regexp_extract("text", rf"(?s)##+ *{re.escape(heading)}[^\n]*\n(.*?)(?:\n##|$)", 1)
    lines = pages.select("page", F.explode(F.split(section, "\n")).alias("line")).where(F.col("line").rlike(r"^\s*\|") & ~F.col("line").rlike(r"^[\s|:-]+$"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.select("page", cells.alias("c")).where((F.size("c") >= 2) & F.col("c")[0].rlike("^[0-9]"))
    title = F.coalesce(F.nullif(F.regexp_extract(F.col("c")[1], r"\[([^\]]+)\]", 1), F.lit("")), F.col("c")[1])
    url = F.regexp_extract(F.col("c")[1], r"\]\(([^)\s]+)\)", 1)
    return rows.select("page", F.col("c")[0].alias("day"), title.alias("title"), url.alias("url")).withColumn("id", F.substring(F.sha2(F.concat_ws("|", "day", "title", "url"), 256), 1, 24))


def json_column(column: Column, kind: str, empty: Column) -> Column:
    """JSON text as a value of a type; what doesn't parse is empty."""
    return F.coalesce(F.from_json(column, kind), empty)
