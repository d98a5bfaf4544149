"""Every query of the core with SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from aeroweave.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events",):
        con.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 3) + 0.0
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (float, int)) and abs(a - b) <= 2e-3 + 1e-6 * abs(a))


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, cursor.fetchall())
    assert len(got) == len(want) > 0
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(map(same, g, w))]
    assert not bad, bad[:3]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_oracle(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0
