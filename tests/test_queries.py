"""Every named query against its DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from companylens.plans.queries import QUERIES
from oracle_queries import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")

# Every query has its SQL.
ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        table, extension = os.path.splitext(name)
        if extension == ".parquet":
            connection.execute(f"create view {table} as select * from '{SF_DIR}/{name}'")
    return connection


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def ordered(columns, rows):
    positions = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(normal(row[i]) for i in positions) for row in rows)


def test_oracles_cover_queries():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    sql = ORACLES.get(name)
    if sql is None:
        return
    cursor = database.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered(df.columns, rows) == ordered(columns, cursor.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
