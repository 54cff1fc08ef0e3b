"""Every registered query with SQL: Spark's rows equal DuckDB's on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from sluice.plans import all_queries, all_sql
from sluice.sources.adapters import BASE


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return str(int(x)) if float(x) == int(x) else f"{float(x):.6g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_equals_sql(name, spark, sf, duck):
    df = all_queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = duck.execute(all_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_runs(name, spark, sf):
    assert all_queries()[name](spark, sf).count() > 0
