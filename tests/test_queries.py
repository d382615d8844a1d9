"""Every registered query of the library against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from fieldstone.plans import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return con


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    query = QUERIES[name]
    df = query.run(spark, sf_dir)
    got = df.collect()
    assert query.covers
    if query.sql is None:
        assert got
        return
    want = duck.sql(query.sql)
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    at = [want.columns.index(c) for c in order]
    assert sorted((plain(r[c] for c in order) for r in got), key=key) == sorted((plain(r[i] for i in at) for r in want.fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
