"""Every query that has SQL gives the rows of that SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def _plain(rows):
    text = lambda x: None if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted((tuple(text(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    columns = sorted(got.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert _plain(map(tuple, got.select(*columns).collect())) == _plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
