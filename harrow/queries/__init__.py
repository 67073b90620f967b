"""Queries over the operators, each beside the SQL that states it for another engine (none where SQL can't)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register ``f(spark, sf_dir)`` under its name."""

    def register(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return register
