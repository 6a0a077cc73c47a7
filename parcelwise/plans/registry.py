"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelwise.plans import attribute_queries, feature_queries, file_queries, record_queries, rule_queries, spatial_queries


PARTS = (spatial_queries, feature_queries, attribute_queries, record_queries, rule_queries, file_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in PARTS for k, (f, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in PARTS for k, (_, s) in part.QUERIES.items() if s}
