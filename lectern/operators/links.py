"""Links, embedded objects and small forms of pages."""

from __future__ import annotations

import json
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lectern.functions.text import collapse_blanks


def _resolved(base: str | None, href: str | None, force_https: bool) -> str | None:
    if not href or not href.strip():
        return None
    try:
        whole = urlsplit(urljoin(base or "", href.strip()))
        if whole.scheme not in ("http", "https") or not whole.hostname:
            return None
        host = whole.netloc.replace(whole.hostname, whole.hostname.lower()) if whole.hostname in whole.netloc else whole.netloc.lower()
        return urlunsplit(("https" if force_https else whole.scheme, host, whole.path or "/", whole.query, whole.fragment))
    except ValueError:
        return None


def resolve_links(base: Column, href: Column, force_https: bool = False) -> Column:
    """Absolute http(s) url of a link of a page; null where it has another scheme or can't be
    read. With force_https (images) http becomes https."""

    @pandas_udf("string")
    def run(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        return pd.Series([_resolved(b, h, force_https) for b, h in zip(bases, hrefs, strict=True)], dtype=object)

    return run(base, href)


def lazy_source(data_src: Column, data_original: Column, src: Column) -> Column:
    """The source of an image that may be loaded late."""
    return F.coalesce(data_src, data_original, src)


def display_width(width: Column, style: Column) -> Column:
    """Pixels that an image's width or style asks for; null if none or out of bounds."""
    told = F.coalesce(F.regexp_extract(width, r"^\s*([0-9]{1,5})(?:px)?\s*$", 1).try_cast("int"), F.regexp_extract(style, r"(?i)(?:^|;)\s*width\s*:\s*([0-9]{1,5})(?:\.[0-9]+)?px", 1).try_cast("int"))
    return F.when(told.between(1, 10_000), told)


def balanced_object(source: str | None, marker: str) -> str | None:
    """The first JSON object after a marker, by its braces; null if it never ends or is no JSON."""
    at = (source or "").find(marker)
    begin = source.find("{", at + len(marker)) if at >= 0 else -1
    if begin < 0:
        return None
    try:
        _, end = json.JSONDecoder().raw_decode(source, begin)
    except ValueError:
        return None
    return source[begin:end]


def embedded_json(source: Column, marker: str) -> Column:
    """The JSON object that stands after a marker in a page's source, as text."""

    @pandas_udf("string")
    def run(sources: pd.Series) -> pd.Series:
        return pd.Series([balanced_object(s, marker) for s in sources], dtype=object)

    return run(source)


def docs_source(url: Column) -> Column:
    """struct(kind, base, public_base, route, repository) of a documentation site's address: a
    directory of a repository on the web, or a site whose route stands behind #."""
    tree = r"(?i)^https?://github\.com/([^/?#]+)/([^/?#]+)/tree/([^/?#]+)/([^?#]+)"
    part = lambda i: F.url_decode(F.regexp_extract(url, tree, i))
    owner, branch, directory = part(1), part(3), F.regexp_replace(part(4), "^/+|/+$", "")
    repository = F.regexp_replace(part(2), r"(?i)\.git$", "")
    is_tree = F.coalesce((owner != "") & (directory != ""), F.lit(False))
    of = lambda host, middle: F.concat(F.lit(host), owner, F.lit("/"), repository, F.lit(middle), branch, F.lit("/"), directory, F.lit("/"))
    site = F.regexp_extract(url, r"^(https?://[^?#]+)", 1)
    path = F.regexp_extract(site, r"^https?://[^/]+(/.*)$", 1)
    last = F.element_at(F.split(path, "/"), -1)
    root = F.when(path == "", F.concat(site, F.lit("/"))).when(path.endswith("/"), site).when(last.contains("."), F.substring(site, F.lit(1), F.length(site) - F.length(last))).otherwise(F.concat(site, F.lit("/")))
    route = F.regexp_replace(F.split_part(F.url_decode(F.regexp_extract(url, r"#/?(.*)$", 1)), F.lit("?"), F.lit(1)), "^/+|/+$", "")
    tree_found = F.struct(F.lit("repository").alias("kind"), of("https://raw.githubusercontent.com/", "/").alias("base"), of("https://github.com/", "/blob/").alias("public_base"), F.lit("").alias("route"), repository.alias("repository"))
    site_found = F.struct(F.lit("site").alias("kind"), root.alias("base"), root.alias("public_base"), route.alias("route"), F.lit("").alias("repository"))
    return F.when(is_tree & ~directory.contains(".."), tree_found).when(~is_tree & (site != ""), site_found)


def heading_key(title: Column) -> Column:
    """What two forms of a heading share: without blanks, "(i/n)" at the end and wide colons."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    narrow = "".join(chr(0x21 + i) for i in range(94))
    plain = F.translate(F.coalesce(title, F.lit("")), wide, narrow)
    return F.regexp_replace(F.regexp_replace(plain, r"\s*\([0-9]+\s*/\s*[0-9]+\)\s*$", ""), r"[\s 　]+", "")


def match_chapter_heading(line: Column, title: Column) -> Column:
    """Is a line the heading of a chapter of that title?"""
    return (heading_key(line) == heading_key(title)) & (heading_key(line) != "")


def preview_text(blocks: DataFrame, most: int = 260, least: int = 80, han: int = 8) -> DataFrame:
    """blocks(id, pos, text) -> (id, preview): the first block of prose, else the first one that
    holds anything, cut at `most`. Blocks that begin with a label aren't prose."""
    line = collapse_blanks(F.col("text"))
    prose = (F.length(line) >= least) & (F.regexp_count(line, F.lit(r"[㐀-鿿]")) >= han) & ~line.rlike(r"(?i)^(?:作者|arxiv|来源|论文信息)[：:\s]")
    best = blocks.where(line != "").groupBy("id").agg(F.min_by(line, F.struct((~prose).alias("other"), F.col("pos").alias("pos"))).alias("line"))
    return best.select("id", F.when(F.length("line") > most, F.concat(F.substring("line", 1, most), F.lit("…"))).otherwise(F.col("line")).alias("preview"))


def article_videos(blocks: DataFrame, most: int = 20, least: int = 8) -> DataFrame:
    """blocks(page_id, pos, src, text), src null for text: (page_id, place, video, anchor) of the
    videos embedded by https, each once, with the text block that follows."""
    video = F.regexp_extract("src", r"^https://(?:www\.)?youtube(?:-nocookie)?\.com/embed/([A-Za-z0-9_-]{11})(?:[?#].*)?$", 1)
    ahead = Window.partitionBy("page_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    long_text = F.when(F.col("src").isNull() & (F.length(F.trim("text")) >= least), F.substring(F.trim("text"), 1, 300))
    rows = blocks.withColumn("anchor", F.first(long_text, ignorenulls=True).over(ahead)).withColumn("video", video).where("video <> ''")
    once = rows.groupBy("page_id", "video").agg(F.min(F.struct("pos", "anchor")).alias("m"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("m.pos"))
    return once.select("page_id", place.alias("place"), "video", F.coalesce("m.anchor", F.lit("")).alias("anchor")).where(F.col("place") <= most)


def drop_empty_lists(blocks: DataFrame) -> DataFrame:
    """blocks(page_id, pos, kind, holder, text): items without text or image go, then lists that
    hold none. holder names the list of an item."""
    kept = blocks.where(~((F.col("kind") == "li") & (F.trim(F.coalesce("text", F.lit(""))) == "")))
    full = kept.where("kind = 'li'").select("page_id", F.col("holder").alias("pos")).distinct()
    return kept.where("kind NOT IN ('ul', 'ol')").unionByName(kept.where("kind IN ('ul', 'ol')").join(full, ["page_id", "pos"], "left_semi").select(*kept.columns))


def drop_decorative_images(blocks: DataFrame) -> DataFrame:
    """blocks(page_id, pos, kind, holder, text): images without alternative text outside of
    figures go, then holders that are empty without them."""
    figures = blocks.where("kind = 'figure'").select("page_id", F.col("pos").alias("holder"))
    images = blocks.where("kind = 'img' AND trim(coalesce(text, '')) = ''").join(figures, ["page_id", "holder"], "left_anti").select("page_id", "pos", "holder")
    kept = blocks.join(images.select("page_id", "pos"), ["page_id", "pos"], "left_anti").select(*blocks.columns)
    held = kept.where("holder IS NOT NULL").select("page_id", F.col("holder").alias("pos")).distinct()
    bare = images.select("page_id", F.col("holder").alias("pos")).distinct().join(held, ["page_id", "pos"], "left_anti")
    empty = kept.where("trim(coalesce(text, '')) = '' AND kind <> 'img'").join(bare, ["page_id", "pos"], "left_semi").select("page_id", "pos")
    return kept.join(empty, ["page_id", "pos"], "left_anti").select(*blocks.columns)


def last_message_per_role(messages: DataFrame) -> DataFrame:
    """messages(conversation_id, turn, role, text): last question, last answer, number."""
    last = lambda role: F.max_by("text", F.when(F.col("role") == role, F.col("turn")))
    return messages.groupBy("conversation_id").agg(last("user").alias("last_question"), last("assistant").alias("last_answer"), F.count("*").alias("messages"))


def manifest_verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest(path, sha256, bytes) against files(path, content): ok, missing or changed."""
    found = files.select("path", F.sha2("content", 256).alias("own_sha256"), F.length("content").cast("long").alias("own_bytes"))
    same = (F.col("own_sha256") == F.col("sha256")) & (F.col("own_bytes") == F.col("bytes"))
    inside = ~F.col("path").rlike(r"(^|/)\.\.(/|$)|^/")
    return manifest.join(found, "path", "left").select("path", F.when(~inside, "outside").when(F.col("own_sha256").isNull(), "missing").when(same, "ok").otherwise("changed").alias("state"))


def latest_digests(digests: DataFrame, schema: str, limit: int = 12) -> DataFrame:
    """digests(id, created_at, digest_json): the newest, their JSON read; broken JSON is empty."""
    most = min(100, max(1, limit))
    return digests.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(most).select("id", "created_at", F.from_json("digest_json", schema).alias("digest"))


def search_excerpt(text: Column, query: str, size: int = 180, before: int = 55) -> Column:
    """`size` characters from some before the first hit, or from the start if there is none."""
    line = collapse_blanks(F.coalesce(text, F.lit("")))
    start = F.greatest(F.lit(0), F.locate(query.lower(), F.lower(line)) - 1 - before)
    return F.concat(F.when(start > 0, "…").otherwise(""), F.substring(line, start + 1, F.lit(size)), F.when(start + size < F.length(line), "…").otherwise(""))


def distinct_hits(*hits: DataFrame) -> DataFrame:
    """(target_type, target_id) that any of the lists names, once."""
    both = hits[0].select("target_type", "target_id")
    for h in hits[1:]:
        both = both.unionByName(h.select("target_type", "target_id"))
    return both.distinct()
