"""Every query with SQL, at the smallest scale, against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from daygrid import catalog
from daygrid.catalog.registry import SQL_DIR

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
SQL = catalog.SQL


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    result = db.sql(SQL[name].replace(SQL_DIR, FOLDER))
    assert sorted(df.columns) == sorted(result.columns)
    columns = sorted(df.columns)
    order = [result.columns.index(c) for c in columns]
    ours = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(str(r[i]) for i in order) for r in result.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
