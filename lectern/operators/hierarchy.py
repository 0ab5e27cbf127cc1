"""Trees given as (id, parent_id): paths, closures, rollups, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.shared import settle


def folder_paths(folders: DataFrame) -> DataFrame:
    """(id, depth, path): the names from the root, joined by /. Folders that no root leads
    to (loops) have none. A level is a table; levels are as many as the tree is deep."""
    level = settle(folders.where("parent_id IS NULL").select("id", F.lit(1).alias("depth"), F.col("name").alias("path")), "level")
    children = settle(folders.where("parent_id IS NOT NULL").select("id", "parent_id", "name"), "children")
    found, depth = level, 1
    while not level.isEmpty():
        depth += 1
        parents = level.select(F.col("id").alias("parent_id"), "path")
        level = settle(children.join(parents, "parent_id").select("id", F.lit(depth).alias("depth"), F.concat_ws("/", "path", "name").alias("path")), "level")
        found = found.unionByName(level)
    return found


def folder_closure(folders: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance), each folder its own ancestor. The reach doubles each
    round, so rounds grow with the logarithm of the depth; pairs are met by their
    shortest way, so that loops end too. A round is a table."""
    edges = folders.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(1).alias("distance"))
    reach, span = settle(edges.distinct(), "reach"), 1
    while True:
        far = reach.where(F.col("distance") == span).select("ancestor", F.col("descendant").alias("middle"))
        on = reach.select(F.col("ancestor").alias("middle"), "descendant", F.col("distance").alias("more"))
        further = far.join(on, "middle").groupBy("ancestor", "descendant").agg((F.min("more") + span).alias("distance"))
        new = settle(further.join(reach, ["ancestor", "descendant"], "left_anti"), "reach")
        if new.isEmpty():
            break
        reach, span = reach.unionByName(new), 2 * span
    return folders.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("distance")).unionByName(reach)


def folder_rollup(folders: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, direct, below, children): items of a folder, of its whole subtree, and folders
    right below. placed(folder_id, ...): one row an item."""
    direct = placed.groupBy("folder_id").agg(F.count("*").alias("n"))
    below = folder_closure(folders).join(direct, F.col("descendant") == F.col("folder_id")).groupBy("ancestor").agg(F.sum("n").alias("below"))
    children = folders.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count("*").alias("children"))
    rows = folders.select("id").join(direct.withColumnsRenamed({"folder_id": "id", "n": "direct"}), "id", "left")
    rows = rows.join(below.withColumnRenamed("ancestor", "id"), "id", "left").join(children.withColumnRenamed("parent_id", "id"), "id", "left")
    return rows.select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("direct", "below", "children")))


def folder_two_levels(folders: DataFrame, placed: DataFrame, items: DataFrame) -> DataFrame:
    """Folders of the first two levels with what their subtrees hold, and a row for items
    without a folder."""
    paths = folder_paths(folders).where("depth <= 2")
    rows = paths.join(folder_rollup(folders, placed), "id").select("path", "depth", F.col("below").alias("items"))
    unfiled = items.join(placed, ["target_type", "target_id"], "left_anti").agg(F.count("*").alias("items")).select(F.lit("(none)").alias("path"), F.lit(0).alias("depth"), "items")
    return rows.unionByName(unfiled)


def folder_cycles(folders: DataFrame) -> DataFrame:
    """Folders that are their own ancestor, among those that no root leads to."""
    lost = folders.join(folder_paths(folders).select("id"), "id", "left_anti").select(*folders.columns)
    return folder_closure(lost).where("distance > 0 AND ancestor = descendant").select(F.col("ancestor").alias("id")).distinct()


def sibling_name_conflicts(folders: DataFrame) -> DataFrame:
    """Names that folders of one parent share but for case."""
    return folders.groupBy(F.coalesce("parent_id", F.lit("")).alias("parent_id"), F.lower("name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def empty_folders(folders: DataFrame, placed: DataFrame) -> DataFrame:
    """Folders without items and without folders below."""
    parents = folders.select(F.col("parent_id").alias("id")).where("id IS NOT NULL")
    return folders.select("id").join(parents, "id", "left_anti").join(placed.select(F.col("folder_id").alias("id")), "id", "left_anti")


def ensure_paths(folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(path) -> paths to create, those of the way included, parents first."""
    parts = F.filter(F.transform(F.split("path", "/"), lambda x: F.trim(x)), lambda x: x != "")
    steps = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))
    prefixes = wanted.select(parts.alias("parts")).where(F.size("parts") > 0).select(F.explode(steps).alias("path")).distinct()
    return prefixes.join(folder_paths(folders).select("path"), "path", "left_anti").select("path", F.size(F.split("path", "/")).alias("depth")).orderBy("depth", "path")
