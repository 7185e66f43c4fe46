"""Named queries, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstead.sources.tables import Tables

Query = Callable[[Tables], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str) -> Callable[[Query], Query]:
        """Register a function of ``Tables`` under its name, with its SQL."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            self.sql[f.__name__] = sql
            return f

        return add

    def entries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return {name: (lambda spark, folder, f=f: f(Tables(spark, folder))) for name, f in self.queries.items()}
