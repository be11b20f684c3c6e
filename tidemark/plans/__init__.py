"""Queries over the driver's tables, by the operators' names."""

from __future__ import annotations

from . import predicate_queries, relational_queries, selection_queries, signal_queries, small_queries, streaming_queries, window_queries  # noqa: F401  registers
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
