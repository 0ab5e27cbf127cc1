"""The registered queries, and SQL that says the same.

A query takes a Library; registered, it takes (spark, folder). Times and days are shown
as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.library import Library, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def shown(df: DataFrame) -> DataFrame:
    """Times and days as text."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind in ("timestamp", "timestamp_ntz", "date")})


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()) -> Callable:
    """Registers a query; sql may start with its own common tables after a comma."""

    def put(f: Callable[[Library], DataFrame]) -> Callable[[Library], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: shown(f(Library(spark, sf_dir)))
        if sql is not None:
            SQL[name] = f"WITH RECURSIVE {ctes(*needs)} {sql}" if needs else sql
        return f

    return put


from lectern.plans import activity, chapters, domain, forms, items, library, positions, records, rules, search, sources, streams, texts  # noqa: E402, F401
