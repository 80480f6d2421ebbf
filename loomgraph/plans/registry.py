"""Where the queries of a module and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """Queries by name, SQL by name, and the decorator that enters a function in both."""
    queries: dict[str, Callable] = {}
    texts: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(fn):
            queries[fn.__name__] = fn
            if sql is not None:
                texts[fn.__name__] = sql
            return fn

        return add

    return queries, texts, query
