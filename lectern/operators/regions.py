"""Columns, tables and figures of a page, and the order in which it reads.

Rows of text are those of layout.text_rows: (doc_id, page, row_y, left, right, text), with
row_y growing downward.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
CAPTION = r"^(?i)(table)\s+[0-9]+[.:]?"
FIGURE = r"^(?i)(fig\.?|figure)\s+[0-9]+[.:]?"


def columns_of(rows: DataFrame, width: float = 612.0, height: float = 792.0, margin: float = 0.055) -> DataFrame:
    """rows with `part`: header, footer, left, right or body (across the page); lone numbers
    in the margin are dropped."""
    middle = width / 2
    band = F.when(F.col("row_y") < margin * height, "header").when(F.col("row_y") > (1 - margin) * height, "footer")
    side = F.when(F.col("right") <= middle, "left").when(F.col("left") >= middle, "right").otherwise("body")
    return rows.withColumn("part", F.coalesce(band, side)).where(~(F.col("part").isin("header", "footer") & F.trim("text").rlike("^[0-9]+$")))


def table_regions(rows: DataFrame, gap: float = 22.0, most: int = 28, least: int = 5) -> DataFrame:
    """(doc_id, page, caption, top, bottom): a caption and the rows below it until a gap of
    `gap`, at most `most` of them and `least` at least."""
    order = Window.partitionBy(*PAGE).orderBy("row_y")
    is_caption = F.col("text").rlike(CAPTION)
    w = rows.withColumn("caption_y", F.last(F.when(is_caption, F.col("row_y")), ignorenulls=True).over(order)).withColumn("caption", F.last(F.when(is_caption, F.col("text")), ignorenulls=True).over(order))
    wide = (F.col("row_y") - F.lag("row_y").over(order) >= gap) & ~is_caption
    w = w.where("caption_y IS NOT NULL").withColumn("wide", F.coalesce(wide, F.lit(False)).cast("int"))
    own = Window.partitionBy(*PAGE, "caption_y").orderBy("row_y")
    body = w.withColumn("gaps", F.sum("wide").over(own)).withColumn("n", F.row_number().over(own) - 1)
    body = body.where((F.col("gaps") == 0) & F.col("n").between(1, most))
    return body.groupBy(*PAGE, "caption_y", "caption").agg(F.count("*").alias("rows"), F.max("row_y").alias("bottom"), F.min("left").alias("left"), F.max("right").alias("right")).where(F.col("rows") >= least).withColumnRenamed("caption_y", "top")


def text_outside_tables(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """rows without those inside tables, each of which is one marker row."""
    met = rows.alias("r").join(tables.select(*PAGE, "top", "bottom").alias("t"), PAGE, "left")
    inside = F.col("top").isNotNull() & F.col("row_y").between(F.col("top"), F.col("bottom"))
    free = met.groupBy(*PAGE, "row_y", "text").agg(F.bool_or(inside).alias("inside")).where("NOT inside").drop("inside")
    marks = tables.select(*PAGE, F.col("top").alias("row_y"), F.concat(F.lit("[table] "), "caption").alias("text"))
    return free.unionByName(marks)


def figure_regions(rows: DataFrame) -> DataFrame:
    """(doc_id, page, caption, top, bottom): from the nearest text above a figure's caption,
    or the top of the page, to the caption."""
    order = Window.partitionBy(*PAGE).orderBy("row_y")
    above = F.coalesce(F.lag("row_y").over(order), F.lit(0))
    w = rows.withColumn("top", above).where(F.col("text").rlike(FIGURE))
    return w.select(*PAGE, F.col("text").alias("caption"), "top", F.col("row_y").alias("bottom"))


def reading_flow(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """Text and figures of a page in order, following lines of text as one piece."""
    f = figures.select(*PAGE, F.col("bottom").alias("row_y"), F.col("caption").alias("text"), F.lit("figure").alias("kind"))
    lines = rows.select(*PAGE, "row_y", "text", F.lit("text").alias("kind")).join(f.select(*PAGE, "row_y"), [*PAGE, "row_y"], "left_anti")
    order = Window.partitionBy(*PAGE).orderBy("row_y")
    w = lines.unionByName(f)
    new = F.coalesce((F.lag("kind").over(order) != F.col("kind")) | (F.col("kind") == "figure"), F.lit(True))
    w = w.withColumn("piece", F.sum(new.cast("int")).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_y", "text"))), lambda x: x["text"]), "\n")
    return w.groupBy(*PAGE, "piece", "kind").agg(text.alias("text"))
