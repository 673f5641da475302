"""The registered queries and their SQL, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules() -> list:
    from . import audit_queries, gap_queries, model_queries, panel_queries, pit_queries, run_queries

    return [pit_queries, panel_queries, model_queries, run_queries, audit_queries, gap_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _modules():
        out |= m.SQL
    return out
