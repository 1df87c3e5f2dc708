"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import boxes, chain, copies, files, ledger, more, records, scalars, sinks, streams

MODULES = (copies,)
CATALOGS = (chain.catalog, sinks.catalog, files.catalog, scalars.catalog, boxes.catalog, ledger.catalog, records.catalog, more.catalog, streams.catalog)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.p2_found(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.queries().items()} | {name: f for c in CATALOGS for name, f in c.runs.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()} | {name: sql for c in CATALOGS for name, sql in c.sql.items()}
