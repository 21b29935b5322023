"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import enrichment, grid, packed, pipeline, retrieval, segment

MODULES = [packed, segment, grid, retrieval, enrichment, pipeline]
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
