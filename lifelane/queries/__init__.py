"""Registered queries, by topic, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations


class Registry:
    """Queries by name and their SQL."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add
