"""Ranks that no single task has to count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.shared import settle


def ranked(rows: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """rows with the place of each in its group, from 1. Rows are sorted over the cluster by
    group and order; within a range they are counted, and the ranges' counts, a row each,
    say what is ahead. A group that holds a third of all rows is spread over as many
    tasks. order should leave no ties."""
    by = [*map(F.col, group), *order]
    spread = rows.repartitionByRange(*by) if by else rows
    held = settle(spread.withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*group, "_range")
    local = held.withColumn(name, F.row_number().over(own.orderBy(*order)).cast("long"))
    counts = held.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = local["_range"] == ahead["_range"]
    for g in group:
        same = same & local[g].eqNullSafe(ahead[g])
    met = local.join(ahead, same)
    return met.select(*(local[c] for c in rows.columns), (local[name] + ahead["_ahead"]).alias(name))
