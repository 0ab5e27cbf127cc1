"""Chapters of documents that come as html of headings, paragraphs and tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.page_regions import holder, root_of, steps

#: The size of a page of a chapter, and titles where headings give none.
PAGE, FRONT, BODY, NTH = 4000, "封面与前言", "正文", "第 {} 章"
OUT = "page_id long, chapter int, part int, title string, text string, chars int"


def pages_of(nodes: Iterator[tuple[bool, list[tuple[str, str]]]], most: int) -> Iterator[list[str]]:
    """Texts of nodes, packed in order into pages of `most` characters. A node is (is it a
    table, [(row, text)]). A node that is larger has pages of its own: a table by rows, packed
    likewise; other texts, and rows that are larger, cut."""

    def cut(text: str) -> Iterator[list[str]]:
        for s in range(0, len(text), most):
            yield [text[s : s + most]]

    def packed(texts: Iterator[str]) -> Iterator[list[str]]:
        held, size = [], 0
        for t in texts:
            if len(t) > most:
                if held:
                    yield held
                yield from cut(t)
                held, size = [], 0
                continue
            if held and size + len(t) > most:
                yield held
                held, size = [], 0
            held.append(t)
            size += len(t)
        if held:
            yield held

    run: list[str] = []
    for table, parts in nodes:
        text = "".join(t for _, t in parts)
        if table and len(text) > most:
            yield from packed(iter(run))
            run = []
            yield from packed("".join(t for _, t in own) for _, own in groupby(parts, lambda p: p[0]))
        else:
            run.append(text)
            if len(text) > most:  # what is before it is full
                yield from packed(iter(run))
                run = []
    yield from packed(iter(run))


def word_chapters(blocks: DataFrame, most: int = PAGE) -> DataFrame:
    """Block rows of a document -> page_id, chapter, part, title, text (nodes by line), chars.

    Nodes are the children of the element around all blocks. Chapters begin at h1 nodes if
    there are two, else at h2 nodes if there are two; what stands before the first is a
    chapter of its own; without them all is one chapter. Chapters over `most` characters
    come in parts, no part has more, and the texts of all parts in order are the
    document's. A task reads the rows of its documents in order and holds one chapter."""
    root = root_of(blocks)
    rows = blocks.where("tag <> 'img'").join(root, "page_id")
    top = F.col("path") == F.col("root")
    depth = F.when(F.col("root") == "", 0).otherwise(F.size(F.split("root", "/")))
    node = F.when(top, F.concat(F.lit("#"), F.col("pos"))).otherwise(holder(steps(), depth + 1))
    counts = rows.groupBy("page_id").agg(F.count_if(top & (F.col("tag") == "h1")).alias("h1"), F.count_if(top & (F.col("tag") == "h2")).alias("h2"))
    level = F.when(F.col("h1") >= 2, "h1").when(F.col("h2") >= 2, "h2")
    table_row = F.regexp_extract(F.array_join(F.slice(steps(), depth + 2, F.lit(10_000)), "/"), "(?:^|/)(tr[0-9]+)", 1)
    ready = rows.join(counts, "page_id").select("page_id", "pos", node.alias("node"), F.when(table_row != "", table_row).otherwise(F.col("pos").cast("string")).alias("row"), "text", F.coalesce(top & (F.col("tag") == level), F.lit(False)).alias("begins"), level.isNotNull().alias("cut"))
    ready = ready.repartition("page_id").sortWithinPartitions("page_id", "pos")

    def chapter(page: int, number: int, title: str, held: list[tuple]) -> list[tuple]:
        nodes = ((name.rpartition("/")[2].startswith("table"), [(r[1], r[2]) for r in own]) for name, own in groupby(held, lambda r: r[0]))
        parts = list(pages_of(nodes, most))
        return [(page, number, n, title if len(parts) == 1 else f"{title}（{n}/{len(parts)}）", "\n".join(p), sum(map(len, p))) for n, p in enumerate(parts, 1)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: list[tuple] = []
        rows = (r for f in frames for r in zip(*(f[c] for c in ("page_id", "node", "row", "text", "begins", "cut")), strict=True))
        for page, own in groupby(rows, lambda r: r[0]):
            held, title, number, begun = [], None, 1, 0
            for _, node, row, text, begins, cut in own:
                if title is None:
                    title = FRONT if cut and not begins else BODY
                if begins:
                    if held:
                        made += chapter(page, number, title, held)
                        held, number = [], number + 1
                    begun += 1
                    title = text.strip() or NTH.format(begun)
                held.append((node, row, text))
            made += chapter(page, number, title, held)
            if len(made) >= 2000:
                yield pd.DataFrame(made, columns=["page_id", "chapter", "part", "title", "text", "chars"])
                made = []
        yield pd.DataFrame(made, columns=["page_id", "chapter", "part", "title", "text", "chars"])

    return ready.mapInPandas(run, OUT)
