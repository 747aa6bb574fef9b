"""Registry of the panel queries and their SQL."""

from __future__ import annotations

from panelforge.plans import factor_queries, formula_queries, panel_queries, portfolio_queries, protocol_queries, stream_queries, table_queries  # noqa: F401
from panelforge.plans.registry import QUERIES, SQL


flagship = panel_queries.flagship


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
