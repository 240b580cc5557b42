"""The queries of the library and the SQL that they are held against."""

from __future__ import annotations

from .plans import outcomes  # noqa: F401  registers its queries
from .plans.queries import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
