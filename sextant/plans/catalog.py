"""All queries of this folder."""

from __future__ import annotations

from . import event_queries, feed_queries, long_queries, scalar_queries, series_queries  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
