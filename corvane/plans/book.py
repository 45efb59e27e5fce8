"""Collects queries and their SQL under the names of their functions."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        """Registers the function, with SQL that gives the same rows."""

        def keep(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep
