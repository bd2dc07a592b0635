"""All query modules outside the optional language-data subpackage."""

from __future__ import annotations

from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from blockloom.queries import change_queries, compaction_queries, drift_queries, engine_queries, hot_key_queries, orphan_queries, relational_queries


def modules() -> list[ModuleType]:
    """Modules with QUERIES and ORACLE, in the order they are registered."""
    return [engine_queries, orphan_queries, drift_queries, change_queries, hot_key_queries, compaction_queries, relational_queries]


def flagship(spark: SparkSession, base: str) -> DataFrame:
    """Logs per recent block, read through the partition index."""
    return engine_queries.flagship(spark, base)
