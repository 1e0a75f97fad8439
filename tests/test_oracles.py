"""Every registered query with SQL against DuckDB over the same tables."""

import math
import os

import duckdb
import pytest

from harrow.plans import catalog

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x if x is None or isinstance(x, (str, bool, int)) else str(x)


def rows(cols, values):
    order = sorted(range(len(cols)), key=cols.__getitem__)
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(name, spark, duck):
    df = catalog.queries()[name](spark, SF)
    cur = duck.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    want = rows(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    near = [(g, w) for g, w in bad if not all(a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1, abs(a)) for a, b in zip(g, w, strict=True))]
    assert not near, near[:3]
