"""Every query with SQL gives the rows of that SQL, and every query runs."""

import datetime
import math

import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings walked_files comments findings "
    "provider_results comment_vectors upstream_files benchmark_items"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return value.isoformat() if isinstance(value, datetime.datetime) else str(value)


@pytest.fixture(scope="module")
def duck(folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, folder, duck, name):
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    assert got == sorted(tuple(plain(r[order.index(c)]) for c in columns) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, folder, name):
    df = entry.queries()[name](spark, folder)
    assert df.columns
    df.count()


def test_entry(spark, folder):
    assert entry.entry(spark).count() == 50
