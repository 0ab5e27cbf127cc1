"""Articles of pages, and books made of the pages' articles: eight pages a book, each a
chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import articles, chapters, page_regions
from lectern.plans.registry import query
from lectern.sources.library import Library
from lectern.sources.shared import settle

BOOK = 8


def bodies(lib: Library) -> DataFrame:
    """(page_id, n, title, body): what stands in each page's article after its heading."""
    html = F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1)
    title = F.regexp_extract(html, r"(?s)<h1>(.*?)</h1>", 1)
    return lib.pages.select(F.floor(F.col("page_id") / BOOK).alias("page_id"), F.col("page_id").alias("n"), title.alias("title"), F.regexp_replace(html, r"(?s)^.*?</h1>", "").alias("body"))


def book(rows: DataFrame, piece: F.Column) -> DataFrame:
    """Eight pieces of html at most in the order of their pages."""
    made = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", piece.alias("piece")))), lambda x: x["piece"]), "")
    return rows.groupBy("page_id").agg(F.concat(F.lit("<html><body>"), made, F.lit("</body></html>")).alias("html"))


def numbered_books(lib: Library) -> DataFrame:
    """A chapter in an element of its own, its heading numbered."""
    number = (F.col("n") % BOOK + 1).cast("string")
    piece = F.concat(F.lit("<div><h2>"), number, F.lit(". "), "title", F.lit("</h2>"), F.regexp_replace("body", "</?(b|br)>", ""), F.lit("</div>"))
    return book(bodies(lib), piece).withColumn("html", F.regexp_replace(F.regexp_replace("html", "<body>", "<body><main>"), "</body>", "</main></body>"))


@query("main_content")
def main_content(lib: Library) -> DataFrame:
    return page_regions.main_content(settle(articles.html_blocks(lib.pages), "blocks"))


@query("drop_promotions")
def drop_promotions(lib: Library) -> DataFrame:
    """What begins like an advertisement does in these pages: a marked line of their own."""
    return page_regions.drop_promotions(settle(articles.html_blocks(lib.pages), "blocks"), r"(?i)^(the|der|el|la|le) ")


@query("fix_headings")
def fix_headings(lib: Library) -> DataFrame:
    return page_regions.fix_headings(articles.html_blocks(lib.pages))


@query("restore_sections")
def restore_sections(lib: Library) -> DataFrame:
    """Of each numbered book, from its longest chapter's blocks."""
    blocks = settle(articles.html_blocks(numbered_books(lib)), "blocks")
    sizes = blocks.groupBy("page_id", "path").agg(F.sum(F.length("text")).alias("n"))
    longest = sizes.groupBy("page_id").agg(F.max_by("path", F.struct("n", "path")).alias("path"))
    main = settle(blocks.join(longest, ["page_id", "path"], "left_semi").select(*blocks.columns), "main")
    return page_regions.restore_sections(blocks, main)


@query("word_chapters")
def word_chapters(lib: Library) -> DataFrame:
    piece = F.concat(F.lit("<h1>"), "title", F.lit("</h1>"), F.regexp_replace("body", "</?(b|br)>", ""))
    return chapters.word_chapters(settle(articles.html_blocks(book(bodies(lib), piece)), "blocks"), 1500)
