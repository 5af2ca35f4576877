"""The registry, and each query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from poolwise import queries as pools

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return sorted(repr(tuple(r[c] for c in names)) for r in table.select(names).to_pylist())


@pytest.mark.parametrize("name", [n for n in pools.QUERIES if n in pools.ORACLE])
def test_query_is_its_sql(spark, sql, name):
    got, expected = pools.QUERIES[name](spark, SF).toArrow(), sql.sql(pools.ORACLE[name]).to_arrow_table()
    assert rows(got) == rows(expected)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(pools.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 63
