"""All named queries of the core and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from memloom.plans import change_queries, function_queries, graph_queries, lifecycle_queries, relational_queries, search_queries, source_queries

_MODULES = (change_queries, function_queries, graph_queries, lifecycle_queries, relational_queries, search_queries, source_queries)
FLAGSHIP = "p4_found"


def queries() -> dict[str, Callable]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for m in _MODULES for name, sql in m.ORACLES.items()}
