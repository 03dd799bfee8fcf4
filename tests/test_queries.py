"""Every query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from larkspur import queries as q


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in q.TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9))


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, sf, duck, name):
    df = q.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=key)
    if name not in q.ORACLE_SQL:
        assert got
        return
    result = duck.execute(q.ORACLE_SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(map(same, a, b)), (a, b)


def test_scans_are_pruned(spark, sf):
    plan = q.engine(spark, sf).query_plan("select sum(l_quantity) by l_returnflag from lineitem where l_tax<0.02")
    assert "PushedFilters: [IsNotNull(l_tax), LessThan(l_tax,0.02)]" in plan
    assert "ReadSchema: struct<l_quantity:double,l_tax:double,l_returnflag:string>" in plan
