"""Every registered query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as driver
from compare import database, rows_of_duckdb, rows_of_spark, spark_types
from acequia.plans.registry import registered
from conftest import SF
from oracle import oracle_sql

QUERIES, SQL = registered(), oracle_sql()


@pytest.fixture(scope="module")
def db():
    return database(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, db, key):
    df = QUERIES[key](spark, SF)
    names, got = rows_of_spark(df)
    expected_names, expected_types, expected = rows_of_duckdb(db, SQL[key])
    assert names == expected_names
    assert spark_types(df) == expected_types
    assert len(got) == len(expected)
    assert got == expected
    assert got, "the parameters should select something"


def test_driver_has_every_query():
    assert set(QUERIES) <= set(driver.queries())
    assert set(SQL) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_returns_rows(spark):
    assert driver.entry(spark).count() > 0
