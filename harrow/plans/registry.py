"""Where the plan modules register their queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise ValueError(f"a query named {fn.__name__!r} exists already")
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def r6(x: Column | str) -> Column:
    """Rounded to 6 places, without a negative zero, so that engines agree."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)
