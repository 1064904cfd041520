"""Every registered query against its SQL at the smallest scale, and the privacy of what queries return."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, comparable
from tracewell.plans.catalog import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data}/{name}.parquet')")
    return connection


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    frame = entry.queries()[name](spark, data)
    columns = sorted(frame.columns)
    rows = sorted(comparable(row) for row in frame.select(columns).collect())
    assert rows
    if name in ORACLES:
        wanted = ", ".join(f'"{column}"' for column in columns)
        expected = duck.execute(f"SELECT {wanted} FROM ({ORACLES[name]}) oracle").fetchall()
        assert rows == sorted(comparable(row) for row in expected)


def test_no_raw_personal_data_in_chunks(spark, data):
    from tests import plain
    from tracewell.sources import tables

    chunks = " ".join(row.text for row in entry.queries()["ingest_chunks"](spark, data).select("text").collect())
    found = 0
    for row in tables.documents(spark, data).select("text").collect():
        for match in plain.ANY.finditer(row.text):
            if match.lastindex > 1:
                found += 1
                assert match[0].strip() not in chunks
    assert found
