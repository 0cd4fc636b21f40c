"""All queries of the panel library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import benchmark_queries, block_queries, cluster_queries, feature_queries, forecast_queries, kernel_queries, panel_queries, routing_queries, selection_queries, settings_queries, source_queries, store_queries, tuning_queries

MODULES = (panel_queries, feature_queries, cluster_queries, forecast_queries, kernel_queries, selection_queries, tuning_queries, block_queries, routing_queries, source_queries, benchmark_queries, settings_queries, store_queries)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
