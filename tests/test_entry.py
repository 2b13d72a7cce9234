"""Queries against their SQL, as the driver compares them."""

import duckdb
import pytest

import __spark_entry__ as e

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = ("op", "pipeline")


def _norm(rows):
    return sorted((tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in e.queries() if not n.startswith(SLOW)))
def test_query(spark, sf, duck, name):
    df = e.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = _norm(tuple(r[c] for c in columns) for r in df.collect())
    if name in e.oracle_sql():
        rel = duck.execute(e.oracle_sql()[name])
        own = [d[0] for d in rel.description]
        assert sorted(own) == columns
        assert _norm(tuple(r[own.index(c)] for c in columns) for r in rel.fetchall()) == got
    else:
        assert got


def test_entry(spark):
    assert e.entry(spark).count() > 0
