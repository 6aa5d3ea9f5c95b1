"""Every query that has an SQL twin gives what DuckDB gives for it; the others run."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.queries() if not n.startswith(("p7", "p8", "p9"))]


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)) if isinstance(v, str) else "", v) if not isinstance(v, (dict, list)) else (True, "", str(v)) for v in r))


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f[:-8]} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    r = duck.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = [tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()]
    assert ordered(got) == ordered(want)


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
