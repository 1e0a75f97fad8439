"""The text operators that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from harrow.llm import queries

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(name, spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    cur = con.execute(SQL[name])
    cols = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == want
