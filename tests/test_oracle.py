"""Every registered query of the engine against its SQL on DuckDB, at the smallest scale."""

import duckdb
import pytest

from penmark.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations events"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, wanted = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert _rows(got).equals(_rows(wanted))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"boosted_stylometry", "boosted_attributions"}))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_flagship(spark):
    assert {r["label"]: r["n"] for r in registry.flagship(spark, FOLDER).collect()} == {"ai": 16, "human": 177, "uncertain": 7}
