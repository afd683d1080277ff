"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from . import entity_queries, file_queries, graph_queries, more_queries, text_queries

MODULES = (entity_queries, text_queries, graph_queries, more_queries, file_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
