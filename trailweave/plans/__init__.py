"""Queries over the driver's tables, each beside its SQL for DuckDB."""

from . import graph_queries, idea_queries, path_queries, state_queries, text_queries, tournament_queries, write_queries

_MODULES = (path_queries, graph_queries, write_queries, tournament_queries, state_queries, text_queries, idea_queries)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.R.sql.items()}
