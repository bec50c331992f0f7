"""All graph queries by name, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from weftgraph.plans import queries_graph, queries_text, queries_write

_PARTS = (queries_graph, queries_write, queries_text)


def queries() -> dict[str, Callable]:
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.SQL.items()}
