"""Tags, topics, favourites, states: what is attached to items, and lists of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ranks import ranked

from lectern.functions.text import fold

KEYS = ["target_type", "target_id"]


def with_tag(items: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    return items.join(tags.where(F.col("tag_name") == tag), KEYS, "left_semi")


def in_folder(items: DataFrame, placed: DataFrame, folder_ids: DataFrame) -> DataFrame:
    """Items placed in one of the folders (folder_id)."""
    return items.join(placed.join(folder_ids, "folder_id", "left_semi"), KEYS, "left_semi")


def flag_favorite(items: DataFrame, favorites: DataFrame) -> DataFrame:
    marked = favorites.select(*KEYS).distinct().withColumn("favorite", F.lit(True))
    return items.join(marked, KEYS, "left").withColumn("favorite", F.coalesce("favorite", F.lit(False)))


def polymorphic_lookup(rows: DataFrame, content: DataFrame) -> DataFrame:
    """rows with the title of the item that they name; rows that name none are dropped."""
    return rows.join(content.select(*KEYS, "title"), KEYS).where("title IS NOT NULL")


def unfiled(items: DataFrame, placed: DataFrame) -> DataFrame:
    return items.join(placed, KEYS, "left_anti")


def auto_file(items: DataFrame, placed: DataFrame) -> DataFrame:
    """Placements for the items that have none: inbox/<category>."""
    return unfiled(items, placed).select(*KEYS, F.concat(F.lit("inbox/"), "category").alias("folder_id"))


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag_name").agg(F.count("*").alias("items"))


def category_counts(items: DataFrame) -> DataFrame:
    """Items of each type and category, with totals (null category)."""
    return items.rollup("target_type", "category").agg(F.count("*").alias("items")).where("target_type IS NOT NULL")


def page_tags(items: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags of each item, sorted without regard to case."""
    sort = F.array_sort(F.collect_set(F.struct(F.lower("tag_name").alias("k"), "tag_name")))
    return items.join(tags, KEYS).groupBy(*KEYS).agg(F.array_join(F.transform(sort, lambda x: x["tag_name"]), ",").alias("tags"))


def content_organization(items: DataFrame, tags: DataFrame, placed: DataFrame) -> DataFrame:
    """Per item its tags and folders as sorted lists; empty where there are none."""
    own_tags = tags.groupBy(*KEYS).agg(F.array_sort(F.collect_set("tag_name")).alias("tags"))
    own_folders = placed.groupBy(*KEYS).agg(F.array_sort(F.collect_set("folder_id")).alias("folders"))
    rows = items.select(*KEYS).join(own_tags, KEYS, "left").join(own_folders, KEYS, "left")
    return rows.select(*KEYS, *(F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("tags", "folders")))


def tenant_visible(rows: DataFrame, owner: int, column: str = "owner_id") -> DataFrame:
    """Public rows (no owner) and the owner's."""
    return rows.where(F.col(column).isNull() | (F.col(column) == owner))


def newest(items: DataFrame, k: int, category: str | None = None) -> DataFrame:
    """The k newest items, of one category if it is given (1 to 1000)."""
    rows = items if category is None else items.where(F.col("category") == category)
    return rows.orderBy(F.col("updated_at").desc(), *KEYS).limit(min(1000, max(1, k)))


def page_clamped(rows: DataFrame, order: list[tuple[str, bool]], size: int, number: int) -> DataFrame:
    """Page `number` from 1, or the last page if there are fewer; order: columns, and whether
    each ascends. Ranks are taken over the cluster, so that a page in the middle of a long
    list costs what the first one does."""
    placed = ranked(rows, [], [F.col(c).asc() if up else F.col(c).desc() for c, up in order], "place")
    total = rows.count()
    last = max(1, -(-total // size))
    use = min(max(1, number), last)
    return placed.where(F.col("place").between((use - 1) * size + 1, use * size)).withColumn("page", F.lit(use)).withColumn("pages", F.lit(last))


def after_key(rows: DataFrame, order: list[str], last: tuple, k: int) -> DataFrame:
    """The k rows that follow `last` in ascending order: paging without counting."""
    where = F.lit(False)
    for i, c in reversed(list(enumerate(order))):
        where = (F.col(c) > F.lit(last[i])) | ((F.col(c) == F.lit(last[i])) & where)
    return rows.where(where).orderBy(*order).limit(k)


def top_per_group(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def history_tail(messages: DataFrame, k: int = 8) -> DataFrame:
    """The last k messages of each conversation, in their order."""
    last = Window.partitionBy("conversation_id").orderBy(F.col("turn").desc())
    tail = messages.withColumn("_back", F.row_number().over(last)).where(F.col("_back") <= k)
    return tail.withColumn("place", F.row_number().over(Window.partitionBy("conversation_id").orderBy("turn"))).drop("_back")


def list_repositories(rows: DataFrame, query: str) -> DataFrame:
    """Repositories of which name, description and language together hold all terms."""
    text = fold(F.concat_ws(" ", "full_name", "description", "primary_language"))
    terms = [t for t in query.lower().split() if t]
    where: Column = F.lit(True)
    for t in terms:
        where &= text.contains(t)
    return rows.where(where)


def repository_statistics(rows: DataFrame) -> DataFrame:
    """Per language: repositories and stars, the most starred one."""
    return rows.groupBy("primary_language").agg(F.count("*").alias("repositories"), F.sum("stars").alias("stars"), F.max(F.struct("stars", "full_name"))["full_name"].alias("most_starred"))


def reading_workspace(items: DataFrame, states: DataFrame, notes: DataFrame) -> DataFrame:
    """Per item its state (unread and 0 by default) and its notes in order."""
    last = states.groupBy(*KEYS).agg(F.max("progress").alias("progress"), F.count("*").alias("readers"))
    own = notes.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("updated_at", "note_text"))).alias("n"))
    rows = items.select(*KEYS, "title").join(last, KEYS, "left").join(own, KEYS, "left")
    return rows.select(*KEYS, "title", F.coalesce("progress", F.lit(0)).alias("progress"), F.coalesce("readers", F.lit(0)).alias("readers"), F.coalesce(F.size("n"), F.lit(0)).alias("notes"))
