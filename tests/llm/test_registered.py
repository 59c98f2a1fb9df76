"""Registered queries beside their SQL, and the table of names."""

import os

import duckdb
import pytest

from daygrid.llm import registered

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registered.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = registered.QUERIES[name](spark, FOLDER)
    result = db.sql(registered.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    order = [result.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(
        tuple(str(r[i]) for i in order) for r in result.fetchall())
