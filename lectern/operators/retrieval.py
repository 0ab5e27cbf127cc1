"""Passages for answers: chunks, terms, scores, and whether a quote is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapse_blanks
from lectern.sources.shared import settle


def chunk_fixed(items: DataFrame, size: int = 1200, overlap: int = 120, least: int = 40) -> DataFrame:
    """items(id, body) -> (chunk_id, id, start, text): windows of `size` characters that
    overlap; a rest of under `least` characters is left out."""
    step = size - overlap
    n = F.length("body")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    rows = items.where(F.col("body") != "").select("id", "body", F.posexplode(starts).alias("k", "start"))
    text = F.substring("body", F.col("start") + 1, F.lit(size))
    rows = rows.select(F.concat("id", F.lit("-C"), (F.col("k") + 1).cast("string")).alias("chunk_id"), "id", F.col("start").cast("long").alias("start"), text.alias("text"))
    return rows.where((F.length("text") >= least) | (F.col("start") == 0))


def query_terms(text: Column, most: int = 80) -> Column:
    """Distinct terms in lower case, the first `most`: Latin words of two characters and more,
    numbers, and of each run of Han characters all pieces of 4, 3 and 2."""
    low = F.lower(F.coalesce(text, F.lit("")))
    latin = F.regexp_extract_all(low, F.lit(r"[a-z][a-z0-9_.+-]+|[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(r"[\u3400-\u9fff]{2,}"), F.lit(0))

    def pieces(run: Column) -> Column:
        of = lambda w: F.when(F.length(run) >= w, F.transform(F.sequence(F.lit(1), F.length(run) - w + 1), lambda i: F.substring(run, i, F.lit(w)))).otherwise(F.array().cast("array<string>"))
        return F.concat(of(4), of(3), of(2))

    return F.slice(F.array_distinct(F.concat(latin, F.flatten(F.transform(runs, pieces)))), 1, most)


def score_chunks(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """Adds `score`: for each term that stands in title or text its length, 6 at most, and 5
    more if the title has it. chunks may come without titles."""
    title = F.lower(F.coalesce(F.col("title"), F.lit(""))) if "title" in chunks.columns else F.lit("")
    text = F.concat(title, F.lit("\n"), F.lower(F.col("text")))
    score = F.lit(0)
    for t in dict.fromkeys(terms):
        score = score + F.when(text.contains(t), F.lit(min(len(t), 6)) + F.when(title.contains(t), 5).otherwise(0)).otherwise(0)
    return chunks.withColumn("score", score.cast("long"))


def select_chunks(scored: DataFrame, per_source: int = 1, most: int = 18) -> DataFrame:
    """The best `per_source` chunks of each source, whatever they score, then the best of all
    others as long as there are fewer than `most`."""
    own = Window.partitionBy("id").orderBy(F.col("score").desc(), "start")
    flagged = scored.withColumn("first", F.row_number().over(own) <= per_source)
    firsts = flagged.where("first")
    others = flagged.where("NOT first").orderBy(F.col("score").desc(), "start", "id").limit(most)
    # `most` rows at most, and one number
    placed = others.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "start", "id")))
    room = firsts.agg((F.lit(most) - F.count("*")).alias("room"))
    return firsts.unionByName(placed.join(F.broadcast(room)).where(F.col("place") <= F.col("room")).drop("place", "room"))


def citation_join(citations: DataFrame, chunks: DataFrame, least: int = 6, most: int = 12) -> DataFrame:
    """citations(answer_id, chunk_id, quote) whose chunk holds the quote, blanks collapsed;
    at most `most` an answer."""
    quote, text = collapse_blanks(F.col("quote")), collapse_blanks(F.col("text"))
    met = citations.join(chunks.select("chunk_id", "text"), "chunk_id").where((F.length(quote) >= least) & text.contains(quote))
    order = Window.partitionBy("answer_id").orderBy("chunk_id", "quote")
    return met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("answer_id", "chunk_id", "quote")


def insufficient_evidence(answers: DataFrame, valid: DataFrame) -> DataFrame:
    """Per answer the number of valid citations, and whether there is none."""
    counts = valid.groupBy("answer_id").agg(F.count("*").alias("citations"))
    return answers.select("answer_id").distinct().join(counts, "answer_id", "left").select("answer_id", F.coalesce("citations", F.lit(0)).alias("citations"), F.col("citations").isNull().alias("insufficient"))


def quoted_passages(quotes: DataFrame, bodies: DataFrame, words: int = 5) -> DataFrame:
    """(item_id, id, at): where a body first holds a whole quote, word for word, blanks alike;
    at counts the body's words from 1. Quotes of fewer words than `words` are met by all of
    theirs. Hashes of word runs meet first; then all words are compared."""

    def split(text: Column) -> Column:
        return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r]+"), lambda x: x != "")

    def runs(size: Column) -> Column:
        return F.when(F.size("w") >= size, F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.struct(i.alias("i"), F.xxhash64(F.array_join(F.slice("w", i, size), " ")).alias("h"))))

    q = quotes.select("item_id", split(F.col("text")).alias("quote")).where(F.size("quote") > 0).withColumn("k", F.least(F.size("quote"), F.lit(words)))
    q = settle(q.withColumn("h", F.xxhash64(F.array_join(F.slice("quote", 1, F.col("k")), " "))), "quotes")
    found = None
    rows = bodies.select("id", split(F.col("body")).alias("w"))
    for k in range(1, words + 1):  # short quotes are few kinds: each size that there is
        own = q.where(F.col("k") == k).select("item_id", "quote", "h")
        if k < words and own.isEmpty():
            continue
        part = rows.select("id", F.explode(runs(F.lit(k))).alias("r")).select("id", "r.i", "r.h").join(own, "h").select("id", "i", "item_id")
        found = part if found is None else found.unionByName(part)
    met = settle(found, "met")
    whole = met.join(rows, "id").join(q.select("item_id", "quote"), "item_id").where(F.slice("w", F.col("i"), F.size("quote")) == F.col("quote"))
    return whole.groupBy("item_id", "id").agg(F.min("i").cast("long").alias("at"))
