"""All registered queries of the library and their SQL."""

from __future__ import annotations

from harrow.plans import advantages, data, evaluation, exact, filed, generated, reports, selection, shaping, sourcing, training  # noqa: F401
from harrow.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
