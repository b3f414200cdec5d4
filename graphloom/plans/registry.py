"""Queries by name, each with the SQL that gives the same rows, if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, run: Query, sql: str | None = None) -> None:
        """Register one query; a name can be used once."""
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = run
        if sql:
            self.sql[name] = sql

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator form of add."""

        def wrap(run: Query) -> Query:
            self.add(name, run, sql)
            return run

        return wrap
