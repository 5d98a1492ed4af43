"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import code_queries, full_search, index_queries, ledger_queries, search_queries, signal_queries, text_queries, view_queries
from .registry import QUERIES, SQL, Query

__all__ = ["code_queries", "full_search", "index_queries", "ledger_queries", "search_queries", "signal_queries", "text_queries", "view_queries"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
