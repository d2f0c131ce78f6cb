"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from earshot.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows(spark, sf_dir, duck, name):
    df = queries.queries()[name](spark, sf_dir)
    want = duck.sql(oracle.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    a = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    b = sorted(tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.SQL)))
def test_without_sql_runs(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
