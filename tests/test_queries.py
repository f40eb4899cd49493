"""Queries against their SQL, run by DuckDB on the same tables."""

import datetime
import math

import duckdb
import pytest

from riskspark import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}" if v else "0"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def normal(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.execute(queries.SQL[name])
    assert normal(got.columns, [tuple(r) for r in got.collect()]) == normal([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
