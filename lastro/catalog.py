"""All queries of the library on the benchmark tables, with their SQL."""

from __future__ import annotations

from .plans import aggregates, choices, contracts, current, files, joins, portals, proposals, registers, reviews, scalars, sets, streams, texts  # noqa: F401  they register their queries
from .plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
