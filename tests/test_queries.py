"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    want = duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rows = sorted((tuple(plain(v) for v in r) for r in want.select(*(f'"{c}"' for c in cols)).fetchall()), key=repr)
    assert [tuple(map(_same, r)) for r in got] == [tuple(map(_same, r)) for r in rows]


def _same(v):
    from decimal import Decimal

    return float(v) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v


def test_entry(spark):
    assert entry.entry(spark).count() > 0
