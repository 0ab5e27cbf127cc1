"""Records of papers, cards and answers: versions, selections, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import first_nonblank, fold
from lectern.operators.maintenance import keep, nonblank, replace, upsert_by_policy


def upsert_papers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Papers (id, title, text, words): text that isn't blank wins, the larger word count
    stays."""
    return upsert_by_policy(old, new, ["id"], {"title": nonblank, "text": nonblank, "words": F.greatest})


def upsert_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Candidates (week, id, title, status): attributes are replaced, the status stays."""
    return upsert_by_policy(old, new, ["week", "id"], {"title": replace, "status": keep})


def survivors(rows: DataFrame, identity: str) -> DataFrame:
    """Of the rows of one identity the one to keep: with text before without, then the
    oldest, then the least id."""
    order = Window.partitionBy(identity).orderBy((F.coalesce(F.trim("text"), F.lit("")) != "").desc(), "created_at", "id")
    return rows.where(F.col(identity).isNotNull()).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def select_candidate(candidates: DataFrame, status: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers to add: the chosen candidate of each open week, unless the paper is there."""
    open_ = candidates.join(status.where("status = 'done'"), "week", "left_anti").where("chosen")
    first = Window.partitionBy("week").orderBy("id")
    return open_.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(papers.select("id"), "id", "left_anti")


def card_summary(body: Column, most: int = 110) -> Column:
    """What follows the first line that isn't blank, on one line, cut."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.array_join(F.slice(lines, 2, 1000), " "), 1, most)


def card_preview(body: Column, size: int = 1000, least: int = 2000) -> Column:
    """The first `size` characters of a text of `least` and more, else the text."""
    return F.when(F.length(body) >= least, F.substring(body, 1, size)).otherwise(body)


def filter_cards(cards: DataFrame, domain: str | None, query: str) -> DataFrame:
    rows = cards if domain is None else cards.where(F.col("domain") == domain)
    return rows.where(fold(F.concat_ws(" ", "title", "body")).contains(fold(F.lit(query))))


def annotations_in_order(notes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Notes with their place in their item."""
    return notes.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def question_sources(asked: DataFrame, content: DataFrame, most: int = 6) -> DataFrame:
    """asked(question, n, target_type, target_id): at most `most` sources of a question, and
    only of questions all of whose sources are there."""
    first = asked.where(F.col("n") <= most)
    lost = first.join(content, ["target_type", "target_id"], "left_anti").select("question").distinct()
    return first.join(content.select("target_type", "target_id", first_nonblank(F.col("summary"), F.col("title")).alias("text")), ["target_type", "target_id"]).join(lost, "question", "left_anti")


def embedded_asset_check(pages: DataFrame, manifest: DataFrame, pattern: str) -> DataFrame:
    """(page_id, path) of assets that html names (group 1 of pattern) and the manifest
    lacks."""
    named = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))).alias("path"))
    return named.join(manifest.select("path"), "path", "left_anti")


def split_dense_text(items: DataFrame, most: int = 190) -> DataFrame:
    """items(id, text) -> sentences packed to blocks of `most` characters, in order. A fold
    over one text's sentences, as an array function."""
    sentences = F.filter(F.split("text", r"(?<=[.!?。！？])\s+"), lambda x: x != "")
    start = F.struct(F.lit("").alias("now"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["now"] == "") | (F.length(s["now"]) + F.length(x) + 1 <= most)
        return F.struct(F.when(s["now"] == "", x).when(fits, F.concat(s["now"], F.lit(" "), x)).otherwise(x).alias("now"), F.when(fits, s["out"]).otherwise(F.concat(s["out"], F.array(s["now"]))).alias("out"))

    packed = F.aggregate(sentences, start, step, lambda s: F.when(s["now"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["now"]))))
    return items.select("id", F.posexplode(packed).alias("pos", "block"))
