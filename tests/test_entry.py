import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    found = entry.queries()[name](spark, FOLDER)
    want = tables.sql(entry.oracle_sql()[name])
    assert _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
