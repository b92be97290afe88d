"""A module's queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable


class Catalog:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        """Registers the decorated function (spark, sf_dir) -> DataFrame; sql is DuckDB's version, if there is one."""

        def put(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.oracle[name] = sql
            return f

        return put
