"""Every query with SQL gives what SQL gives, on the small test tables where they are there."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
CORE = [n for n in entry.catalogue.QUERIES]


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return c


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = table(df.columns, df.collect())
    if name in entry.oracle_sql():
        want = duck.sql(entry.oracle_sql()[name])
        assert got == table(want.columns, want.fetchall())
    else:
        assert df.columns
