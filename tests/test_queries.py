"""Every registered query against its SQL, over the smallest test scale."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from refreshgate import queries as named

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in sorted(os.listdir(SF_DIR)):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF_DIR}/{file}'")
    return con


NAMES = [query.__name__ for query in named.QUERIES]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == columns
    place = [relation.columns.index(c) for c in columns]
    types = dict(df.dtypes)
    assert [str(relation.types[i]) for i in place] == [TYPES[types[c]] for c in columns]
    assert got == sorted((tuple(r[i] for i in place) for r in relation.fetchall()), key=repr)


def test_registry():
    assert set(SQL) <= set(entry.queries())
    assert set(NAMES) <= set(entry.queries())
    assert set(NAMES) <= set(SQL)


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["entity_name", "entity_type", "src_group"]
