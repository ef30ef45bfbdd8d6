"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rillwork.plans import catalog

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()))
    want = sorted(db.sql(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLE_SQL[name]})").fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_package_that_fails_to_import_leaves_the_rest(monkeypatch):
    import importlib

    def broken(name):
        raise ImportError("no such library", name="somelib")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.warns(UserWarning, match="left out"):
        assert set(entry.queries()) == set(catalog.QUERIES)
        assert set(entry.oracle_sql()) == set(catalog.ORACLE_SQL)


def test_every_sql_is_text_that_duckdb_runs(db):
    for name, sql in entry.oracle_sql().items():
        assert isinstance(sql, str)
        db.sql(f"EXPLAIN {sql}")
