"""Search over the library's items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import excerpt, fold, literal_contains
from lectern.operators.ranks import ranked
from lectern.sources.shared import settle

KEYS = ["target_type", "target_id"]


def hits_in(items: DataFrame, kind: str, fields: list[str], query: str) -> DataFrame:
    """Ids of the items of one kind of which a field holds the query, with the first such
    field and the text around the hit."""
    found = F.coalesce(*(F.when(literal_contains(F.col(f), query), F.lit(f)) for f in fields))
    text = F.coalesce(*(F.when(literal_contains(F.col(f), query), F.col(f)) for f in fields))
    return items.where(found.isNotNull()).select(F.lit(kind).alias("target_type"), F.col("id").alias("target_id"), found.alias("field"), excerpt(text, query).alias("excerpt"))


def fallback_hits(hits: DataFrame, annotations: DataFrame, query: str, field: str = "note") -> DataFrame:
    """Items that no own field found, by the newest annotation that does."""
    newest = Window.partitionBy(*KEYS).orderBy(F.col("updated_at").desc(), F.col("note_text"))
    more = annotations.where(literal_contains(F.col("note_text"), query)).join(hits, KEYS, "left_anti").withColumn("n", F.row_number().over(newest)).where("n = 1")
    return hits.unionByName(more.select(*KEYS, F.lit(field).alias("field"), excerpt(F.col("note_text"), query).alias("excerpt")))


#: Places up to which a page is taken from the head of the rows; beyond, rows are ranked over
#: the cluster.
NEAR = 10_000


def paged(rows: DataFrame, order: list, limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """Rows of one page in order, with their place, the number of all rows and whether more
    follow; a page has 1 to `most` rows. A page near the front is numbered in one task, with the
    rows before it; for one further on all rows are ranked, range by range."""
    limit, offset = min(most, max(1, limit)), min(2**31 - 1, max(0, offset))
    total = rows.agg(F.count("*").alias("total"))
    if offset + limit <= NEAR:
        head = rows.orderBy(*order).limit(offset + limit)
        placed = head.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        placed = ranked(rows, [], [c if isinstance(c, Column) else F.col(c) for c in order], "place")
    placed = placed.where((F.col("place") > offset) & (F.col("place") <= offset + limit))
    return placed.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def first_field(fields: list[str], query: str) -> Column:
    return F.coalesce(*(F.when(literal_contains(F.col(f), query), F.lit(f)) for f in fields))


def candidates(sources: list[tuple[DataFrame, str, list[str]]], notes: list[tuple[DataFrame, list[str]]], query: str) -> DataFrame:
    """(target_type, target_id, source, field): items that hold the query, once; source is 0 for
    a field of their own, else the number of the first kind of notes that does. No texts
    are kept."""
    found = None
    for items, kind, fields in sources:
        rows = items.select(F.lit(kind).alias("target_type"), F.col("id").alias("target_id"), F.lit(0).alias("source"), first_field(fields, query).alias("field"))
        found = rows if found is None else found.unionByName(rows)
    for n, (rows, fields) in enumerate(notes, 1):
        found = found.unionByName(rows.select(*KEYS, F.lit(n).alias("source"), first_field(fields, query).alias("field")))
    hits = found.where(F.col("field").isNotNull())
    return hits.groupBy(*KEYS).agg(F.min(F.struct("source", "field")).alias("_x")).select(*KEYS, "_x.source", "_x.field")


def excerpts(page: DataFrame, sources: list[tuple[DataFrame, str, list[str]]], notes: list[tuple[DataFrame, list[str]]], query: str) -> DataFrame:
    """(target_type, target_id, field, excerpt) of a page's items, at most 200: of their own first
    field that holds the query, or of the newest note of the first kind that does."""
    keys = F.broadcast(page.select(*KEYS, "source"))  # a page
    made = None
    for items, kind, fields in sources:
        own = items.withColumn("target_type", F.lit(kind)).withColumnRenamed("id", "target_id").join(keys.where("source = 0"), KEYS)
        text = F.coalesce(*(F.when(literal_contains(F.col(f), query), F.col(f)) for f in fields))
        rows = own.select(*KEYS, first_field(fields, query).alias("field"), excerpt(text, query).alias("excerpt"))
        made = rows if made is None else made.unionByName(rows)
    for n, (rows, fields) in enumerate(notes, 1):
        text = F.coalesce(*(F.when(literal_contains(F.col(f), query), F.col(f)) for f in fields))
        told = rows.join(keys.where(F.col("source") == n), KEYS).select(*KEYS, "updated_at", first_field(fields, query).alias("field"), text.alias("_text")).where("field IS NOT NULL")
        newest = told.groupBy(*KEYS).agg(F.max_by(F.struct("field", "_text"), F.struct("updated_at", "_text")).alias("_x"))
        made = made.unionByName(newest.select(*KEYS, "_x.field", excerpt(F.col("_x._text"), query).alias("excerpt")))
    return made


def search_library(
    sources: list[tuple[DataFrame, str, list[str]]],
    content: DataFrame,
    favorites: DataFrame,
    tags: DataFrame,
    query: str,
    limit: int = 50,
    offset: int = 0,
    notes: list[tuple[DataFrame, list[str]]] | None = None,
    folders: DataFrame | None = None,
    target_type: str | None = None,
    category: str | None = None,
    tag: str | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Items of all kinds that hold the query in a field of their own or in a note, newest first,
    one page with tags, favourite flag and excerpt. notes: (target_type, target_id, updated_at,
    fields) of each kind of notes with the fields to be searched, in the order in which they
    count. A query is trimmed and cut to 200 characters; a blank one finds nothing. Texts
    and tags meet the page's items alone."""
    query = query.strip()[:200]
    sources, notes = [s for s in sources if target_type in (None, s[1])], notes or []
    if not query:  # nothing is found
        content = content.where("false")
    listed = content.where(F.col("category") == category) if category else content
    if target_type:
        listed = listed.where(F.col("target_type") == target_type)
    if tag:
        listed = listed.join(tags.where(F.col("tag_name") == tag), KEYS, "left_semi")
    if folder:
        listed = listed.join(folders.where(F.col("folder_id") == folder), KEYS, "left_semi")
    hits = candidates(sources, notes, query)
    found = settle(hits.join(listed.select(*KEYS, "updated_at"), KEYS), "listed")
    page = settle(paged(found, [F.col("updated_at").desc(), "target_type", "target_id"], limit, offset).drop("updated_at"), "page")
    keys = F.broadcast(page.select(*KEYS))  # a page
    shown = content.select(*KEYS, "title", "category").join(keys, KEYS, "left_semi")
    own_tags = tags.join(keys, KEYS, "left_semi").groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_set("tag_name")), ",").alias("tags"))
    marked = favorites.join(keys, KEYS, "left_semi").select(*KEYS).distinct().withColumn("favorite", F.lit(True))
    around = excerpts(page, sources, notes, query).withColumnRenamed("field", "_field")
    page = page.join(shown, KEYS).join(own_tags, KEYS, "left").join(marked, KEYS, "left").join(around, KEYS, "left")
    return page.select("place", *KEYS, "title", "category", F.coalesce("_field", "field").alias("field"), "excerpt", "total", "has_more", F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("favorite", F.lit(False)).alias("favorite"))


def tokens(items: DataFrame, text: str, key: str = "id") -> DataFrame:
    """(key, token, n, size): how often each word stands in an item, and the item's words."""
    words = items.select(key, F.filter(F.split(fold(F.col(text)), "[^a-z0-9]+"), lambda x: x != "").alias("words"))
    return words.select(key, F.size("words").alias("size"), F.explode("words").alias("token")).groupBy(key, "size", "token").agg(F.count("*").alias("n"))


def begins(term: str) -> Callable[[Column], Column]:
    return lambda word: word.startswith(term)


def prefix_search(items: DataFrame, texts: list[str], terms: list[str], k: int = 20, k1: float = 1.2, b: float = 0.75, key: str = "id") -> DataFrame:
    """Items in which every term begins a word of one of the texts, by BM25 over the terms, then
    the newest, then by key. Words are counted row by row; only counts are kept and
    gathered."""
    words = F.filter(F.split(F.concat_ws(" ", *(fold(F.col(t)) for t in texts)), "[^a-z0-9]+"), lambda x: x != "")
    spots = [f"tf{i}" for i in range(len(terms))]
    rows = items.select(key, "updated_at", words.alias("words"))
    rows = settle(rows.select(key, "updated_at", F.size("words").alias("size"), *(F.size(F.filter("words", begins(t))).alias(s) for s, t in zip(spots, terms, strict=True))), "words")
    stats = rows.agg(F.count("*").alias("items"), F.avg("size").alias("mean"), *(F.count_if(F.col(s) > 0).alias(f"{s}_df") for s in spots))
    score = F.lit(0.0)
    for s in spots:
        idf = F.log((F.col("items") - F.col(f"{s}_df") + 0.5) / (F.col(f"{s}_df") + 0.5) + 1)
        score = score + idf * F.col(s) * (k1 + 1) / (F.col(s) + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    met = rows.where(" AND ".join(f"{s} > 0" for s in spots)).join(F.broadcast(stats))  # one row
    found = met.select(key, "updated_at", F.round(score, 6).alias("score"))
    return found.orderBy(F.col("score").desc(), F.col("updated_at").desc(), key).limit(k).select(key, "score")


def scored_search(items: DataFrame, query: str, k: int = 80, key: str = "id") -> DataFrame:
    """By how the title meets the query: equal 100, begins 80, holds 60; body only 20."""
    title, q = fold(F.col("title")), fold(F.lit(query))
    score = F.when(title == q, 100).when(title.startswith(q), 80).when(title.contains(q), 60).when(literal_contains(F.col("body"), query), 20)
    return items.withColumn("score", score).where("score IS NOT NULL").orderBy(F.col("score").desc(), F.col("updated_at").desc(), key).limit(k).select(key, "title", "score")


def search_conversations(messages: DataFrame, query: str) -> DataFrame:
    """Conversations of which a message holds the query: number of messages, title (the
    first user message) and last message."""
    hit = messages.where(literal_contains(F.col("text"), query)).select("conversation_id").distinct()
    own = messages.join(hit, "conversation_id", "left_semi")
    return own.groupBy("conversation_id").agg(
        F.count("*").alias("messages"),
        F.substring(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))), 1, 80).alias("title"),
        F.substring(F.max_by("text", "turn"), 1, 80).alias("last"),
    )
