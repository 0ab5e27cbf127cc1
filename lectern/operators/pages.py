"""Web pages as articles: metadata, structure, and whether a translation kept it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.maintenance import Snapshots
from lectern.sources.shared import settle

#: Structures counted in html: name and pattern.
STRUCTURES = {
    "images": "<img[^a-zA-Z]",
    "tables": "<table[^a-zA-Z]",
    "headings": "<h[1-6][^0-9a-zA-Z]",
    "paragraphs": "<p[^a-zA-Z]",
    "lists": "<[ou]l[^a-zA-Z]",
    "items": "<li[^a-zA-Z]",
    "links": "<a[^a-zA-Z]",
    "code": "<(pre|code)[^a-zA-Z]",
}


def raw_pages(pages: DataFrame, most: int = 15_000_000) -> DataFrame:
    """Pages that aren't blank and not over the size."""
    return pages.where((F.trim("html") != "") & (F.octet_length("html") <= most))


def structure_counts(html: Column) -> list[Column]:
    """How many of each structure html holds."""
    lower = F.lower(html)
    return [F.regexp_count(lower, F.lit(p)).cast("long").alias(name) for name, p in STRUCTURES.items()]


def page_metadata(pages: DataFrame) -> DataFrame:
    """page_id, title, lang, description."""
    lower = F.col("html")
    return pages.select(
        "page_id",
        F.regexp_extract(lower, "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(lower, '<html lang="([a-z-]+)"', 1).alias("lang"),
        F.length(F.regexp_extract(lower, '<meta name="description" content="([^"]*)"', 1)).cast("long").alias("description_chars"),
    )


def translation_fidelity(pairs: DataFrame, source: str, translated: str) -> DataFrame:
    """pairs with `missing`: structures of which the translation has fewer, and status:
    complete, or degraded if one is missing or under 70 % of the headings are left."""
    a = F.struct(*structure_counts(F.col(source)))
    b = F.struct(*structure_counts(F.col(translated)))
    rows = pairs.withColumn("a", a).withColumn("b", b)
    lost = [F.when(F.col(f"b.{n}") < F.col(f"a.{n}"), n) for n in STRUCTURES if n != "headings"]
    few = F.when(F.col("b.headings") < 0.7 * F.col("a.headings"), "headings")
    missing = F.array_join(F.array_compact(F.array(*lost, few)), ",")
    return rows.withColumn("missing", missing).withColumn("status", F.when(F.col("missing") == "", "complete").otherwise("degraded")).drop("a", "b")


def protected_markers(pairs: DataFrame, source: str, output: str, pattern: str = r"\[\[[A-Z]+[0-9]+\]\]") -> DataFrame:
    """pairs with `kept`: does the output hold the same markers as often as the source?"""
    marks = lambda c: F.array_sort(F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(0)))
    return pairs.withColumn("kept", marks(source) == marks(output))


def html_violations(pages: DataFrame, allowed: list[str]) -> DataFrame:
    """page_id and the tags outside the allowed ones."""
    tags = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), lambda x: F.lower(x)))
    bad = F.array_sort(F.array_except(tags, F.array(*map(F.lit, allowed))))
    return pages.select("page_id", F.array_join(bad, ",").alias("tags")).where("tags <> ''")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href) of every link, once."""
    return pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("href"))


def embedded_images(pages: DataFrame) -> DataFrame:
    """(page_id, kind, sha256, bytes) of images inside data urls."""
    found = F.explode(F.regexp_extract_all("html", F.lit('src="(data:image/[a-z]+;base64,[A-Za-z0-9+/=]+)"'), F.lit(1)))
    rows = pages.select("page_id", found.alias("u"))
    data = F.unbase64(F.substring_index("u", "base64,", -1))
    return rows.select("page_id", F.regexp_extract("u", "data:image/([a-z]+)", 1).alias("kind"), F.sha2(data, 256).alias("sha256"), F.octet_length(data).alias("bytes"))


#: The version of the metrics of structure_counts() and translation_fidelity().
METRICS = 3


def revalidate_structures(store: Snapshots, papers: DataFrame, ids: DataFrame, version: int = METRICS) -> DataFrame:
    """papers(id, source_html, translation_html, status, validation) -> (id, previous, fidelity)
    of what was checked; the store gets its new metrics beside those that stay.

    Checked are the papers of ids, each once, that are ready, validated by the machine, with
    both texts, and whose metrics in the store are missing or of an older version. Texts
    of other papers are not read, and none at all if nothing is due, when the store stays
    as it is."""
    spark = papers.sparkSession
    kind = "id string, metric_version int, missing string, fidelity string"
    before = store.read() if store.number() else spark.createDataFrame([], kind)
    current = before.where(F.col("metric_version") >= version).select("id")
    ready = papers.where("status = 'ready' AND validation = 'auto'").select("id")
    due = settle(ids.select(F.trim("id").alias("id")).where("id <> ''").distinct().join(ready, "id", "left_semi").join(current, "id", "left_anti"), "due")
    previous = due.join(before.select("id", F.col("fidelity").alias("previous")), "id", "left").select("id", F.coalesce("previous", F.lit("unknown")).alias("previous"))
    if not due.head(1):
        return previous.withColumn("fidelity", F.lit("")).where("false")
    texts = papers.join(due, "id", "left_semi").where("trim(source_html) <> '' AND trim(translation_html) <> ''")
    checked = translation_fidelity(texts, "source_html", "translation_html").select("id", F.lit(version).alias("metric_version"), "missing", F.col("status").alias("fidelity"))
    checked = settle(checked, "checked")
    store.publish(before.join(checked.select("id"), "id", "left_anti").unionByName(checked))
    return previous.join(checked.select("id", "fidelity"), "id")


def revalidation_summary(checked: DataFrame) -> DataFrame:
    """One row: checked, complete, degraded."""
    return checked.agg(F.count("*").alias("checked"), F.count_if(F.col("fidelity") == "complete").alias("complete"), F.count_if(F.col("fidelity") == "degraded").alias("degraded"))
