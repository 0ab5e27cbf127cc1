"""Upserts, erasures and versions of tables, as jobs that make a new table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert_keep_first(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of old stay; of new rows with a new key the first by `order` joins them."""
    first = Window.partitionBy(*keys).orderBy(*order)
    fresh = new.join(old, keys, "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return old.unionByName(fresh)


def upsert_last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the last row by `order`; by aggregation, so that hot keys are reduced
    before they move."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def upsert_by_policy(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Full outer join on keys; policy says, column by column, what becomes of (old, new)
    where both rows are there."""
    o, n = old.select(*(F.col(k).alias(f"o_{k}") for k in old.columns), F.lit(True).alias("o_")), new.select(*(F.col(k).alias(f"n_{k}") for k in new.columns), F.lit(True).alias("n_"))
    joined = o.join(n, [F.col(f"o_{k}") == F.col(f"n_{k}") for k in keys], "full_outer")
    out = [F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in keys]
    for c, how in policy.items():
        was, now = F.col(f"o_{c}"), F.col(f"n_{c}")
        out.append(F.when(F.col("o_").isNull(), now).when(F.col("n_").isNull(), was).otherwise(how(was, now)).alias(c))
    return joined.select(*out)


def keep(old: Column, new: Column) -> Column:
    return old


def replace(old: Column, new: Column) -> Column:
    return new


def nonblank(old: Column, new: Column) -> Column:
    """The new value unless it is blank."""
    return F.when(F.coalesce(F.trim(new), F.lit("")) != "", new).otherwise(old)


def batch_assign(assigned: DataFrame, wanted: DataFrame, items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One folder an item: the last wish of a key wins; a batch that names an unknown item
    changes nothing."""
    batch = upsert_last_wins(wanted, keys, order)
    unknown = batch.join(items, keys, "left_anti").agg(F.count("*").alias("_unknown"))
    accepted = batch.join(F.broadcast(unknown)).where("_unknown = 0").drop("_unknown").select(*assigned.columns)
    return assigned.join(accepted, keys, "left_anti").unionByName(accepted)


def erase_targets(tables: dict[str, DataFrame], erased: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Every table without the rows of the erased items."""
    gone = erased.select(*keys).distinct()
    return {name: rows.join(gone, keys, "left_anti") for name, rows in tables.items()}


def reclaimable_files(queued: DataFrame, live: DataFrame, key: str = "path") -> DataFrame:
    """Files queued for removal that no live row refers to."""
    return queued.join(live.select(key), key, "left_anti")


def expired(snapshots: DataFrame, now: str, days: int) -> DataFrame:
    """snapshots(kind, path, made_at) older than `days` (1 to 3650), never the newest."""
    newest = Window.partitionBy("kind").orderBy(F.col("made_at").desc(), "path")
    kept = min(3650, max(1, days))
    return snapshots.withColumn("_n", F.row_number().over(newest)).where((F.col("_n") > 1) & (F.col("made_at") < F.expr(f"timestamp_ntz'{now}' - interval {kept} days"))).drop("_n")


def asset_reference_check(references: DataFrame, manifest: DataFrame) -> DataFrame:
    """references(path, sha256, size) against manifest: what is wrong with each."""
    m = manifest.select("path", F.col("sha256").alias("m_sha256"), F.col("size").alias("m_size"))
    wrong = F.when(F.col("m_sha256").isNull(), "missing").when(F.col("m_sha256") != F.col("sha256"), "hash").when(F.col("m_size") != F.col("size"), "size")
    return references.join(m, "path", "left").withColumn("problem", wrong).where("problem IS NOT NULL").select("path", "problem")


class Snapshots:
    """Versions of a table in a folder. A version is published by its numbered pointer, after its
    data and checks; a failed batch leaves the last version as it was. A pointer is written
    under another name and then renamed, which the file system refuses if the number is
    taken: of two that publish at once one fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def publish(self, rows: DataFrame, checks: dict[str, Column] | None = None, note: str | None = None) -> str:
        """Write rows; every check must hold on all of them. Returns the version. The note
        becomes known together with the rows."""
        version = uuid.uuid4().hex
        staged = f"{self.path}/data/{version}"
        rows.write.parquet(staged)
        if checks:
            made = self.spark.read.schema(rows.schema).parquet(staged)
            failed = made.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items())).first().asDict()
            if any(failed.values()):
                raise ValueError(f"rows that fail: { {k: v for k, v in failed.items() if v} }")
        self._point(json.dumps({"version": version, "number": self.number() + 1, "note": note}))
        return version

    def _point(self, text: str) -> None:
        files = self.spark._jvm.org.apache.hadoop.fs
        place = files.Path(f"{self.path}/pointers/{json.loads(text)['number']}")
        draft = files.Path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        own = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        own.mkdirs(place.getParent())
        out = own.create(draft, False)
        out.write(text.encode())
        out.close()
        context = files.FileContext.getFileContext(own.getUri(), self.spark._jsc.hadoopConfiguration())
        renames = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        renames[0] = getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        context.rename(draft, place, renames)

    def number(self) -> int:
        """The number of the last version; 0 before the first."""
        try:
            return self.versions().agg(F.max("number")).first()[0] or 0
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    def versions(self) -> DataFrame:
        listed = self.spark.read.text(f"{self.path}/pointers/*")
        parts = (F.get_json_object("value", f"$.{c}").alias(c) for c in ("version", "number", "note"))
        return listed.select(*parts).withColumn("number", F.col("number").cast("long"))

    def note(self) -> str | None:
        """The note of the last version."""
        return self.versions().agg(F.max_by("note", "number")).first()[0] if self.number() else None

    def read(self) -> DataFrame:
        latest = self.versions().agg(F.max_by("version", "number")).first()[0]
        return self.spark.read.parquet(f"{self.path}/data/{latest}")
