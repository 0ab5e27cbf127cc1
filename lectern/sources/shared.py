"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or, where all run in one process (tests) and none is
    set, in a temporary folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lectern_folder", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = spark._lectern_folder = "file://" + tempfile.mkdtemp(prefix="spark-lectern-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read from there: later jobs begin here."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
