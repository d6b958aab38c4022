"""How a plan file registers its queries."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """(queries by name, SQL by name, decorator that adds a function to both)."""
    found: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def keep(f):
            found[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f
        return keep
    return found, sql, query
