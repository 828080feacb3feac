"""How a module of queries keeps each query beside its SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """Two empty dictionaries, of queries and of their SQL, and the decorator that fills both."""
    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None) -> Callable:
        def put(f: Callable) -> Callable:
            queries[name] = f
            if sql:
                oracles[name] = sql
            return f

        return put

    return queries, oracles, query
