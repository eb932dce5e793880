"""Every registered query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from pitchloom.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events".split()


def normal(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        connection.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return connection


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = Q.QUERIES[name](spark, sf_dir)
    expected = duck.sql(Q.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    want = sorted(tuple(normal(r[expected.columns.index(c)]) for c in columns) for r in expected.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
