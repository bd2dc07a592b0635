"""Leaked evaluation passages (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm.contamination import leak_report, leaked_windows
from blockloom.session import table


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return leaked_windows(table(spark, base, "documents"), table(spark, base, "eval_items")).select("doc_id", "item_id").distinct()


def p8_report(spark: SparkSession, base: str) -> DataFrame:
    items = table(spark, base, "eval_items")
    return leak_report(leaked_windows(table(spark, base, "documents"), items), items)


QUERIES = {"p8_found": p8_found, "p8_report": p8_report}
ORACLE: dict[str, str] = {}
