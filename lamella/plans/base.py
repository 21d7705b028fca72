"""How a module lists its queries: a function of (spark, sf_dir) each, with its DuckDB twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Listing:
    """Queries in the order of their definition."""

    def __init__(self):
        self._queries: dict[str, Query] = {}
        self._sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        """Decorator: list a function under its own name or ``name``."""

        def keep(f: Query) -> Query:
            key = name or f.__name__
            self._queries[key] = f
            if sql is not None:
                self._sql[key] = sql
            return f

        return keep

    def queries(self) -> dict[str, Query]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)
