"""All queries of the warehouse half of the library, and their SQL twins."""

from __future__ import annotations

from tallyhouse.plans import directory, exports, generations, grids, more, pages, pipelines, prices, scalars, state  # noqa: F401  registers on import
from tallyhouse.plans.register import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
