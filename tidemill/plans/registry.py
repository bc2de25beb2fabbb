"""Registered queries of the bar-research operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bar_queries, evidence_queries, quality_queries, study_queries

_MODULES = (quality_queries, bar_queries, study_queries, evidence_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.Q.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _MODULES for name, s in m.Q.sql.items()}
