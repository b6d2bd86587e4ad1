"""Every registered query against its SQL form in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as driver

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    return connection


def normal(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def test_every_query_has_an_oracle():
    assert set(driver.core_oracle_sql()) == set(driver.core_queries())


@pytest.mark.parametrize("name", list(driver.core_queries()))
def test_query(spark, duck, name):
    frame = driver.queries()[name](spark, SF_DIR)
    result = duck.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = [tuple(map(normal, row)) for row in result.fetchall()]
    got = [tuple(map(normal, row)) for row in frame.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_entry(spark):
    assert driver.entry(spark).count() == 403
