"""Query key -> Spark query and the SQL another engine can check it with."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.tables import SQL_VIEWS

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Registers a function (spark, sf_dir) under its name; sql may use the standing views."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            if views:
                body = "WITH RECURSIVE " + SQL_VIEWS.strip() + ((",\n" + body[5:]) if body.startswith("WITH ") else "\n" + body)
            _SQL[f.__name__] = body
        return f

    return register


def _load() -> None:
    from . import code_queries, graph_queries, index_queries, relation_queries, search_queries, symbol_queries, syntax_queries, text_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
