"""A catalog of named queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import table

Tables = Callable[[str], DataFrame]


class Catalog:
    """Queries of one module: functions of a table reader, registered by decorator."""

    def __init__(self):
        self.runs: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def register(f: Callable[[Tables], DataFrame]):
            self.runs[name] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t))
            if sql:
                self.sql[name] = sql
            return f

        return register
