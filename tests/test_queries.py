"""Every registered query of the library against its SQL."""

import os

import pandas as pd
import pytest

from lectern.plans.registry import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    import duckdb

    made = duckdb.connect()
    for t in TABLES:
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return made


def shown(df, columns):
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, float):  # a whole number where a column holds nulls
            return str(int(x)) if x.is_integer() else repr(x)
        return str(x)

    return sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = database.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert shown(got, columns) == shown(want, columns)


def test_entry_works_without_the_other_operators(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    monkeypatch.setattr("importlib.util.find_spec", lambda name, *a, real=importlib.util.find_spec: None if name.startswith(("lectern.llm", "corpus_pipeline")) else real(name, *a))
    again = importlib.reload(entry)
    assert again.queries().keys() == QUERIES.keys() and again.oracle_sql().keys() == SQL.keys()
    monkeypatch.undo()
    importlib.reload(entry)
