"""Queries of the operators for training text and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import corpus_queries, field_queries, issuer_queries, review_queries

MODULES = (corpus_queries, field_queries, issuer_queries, review_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES if hasattr(m, "oracle_sql") for name, sql in m.oracle_sql().items()}
