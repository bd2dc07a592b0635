"""Abusive language in the archive (problem 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.severity import score, train
from blockloom.session import table

#: Expected grade (of 0 to 2) from which a document counts as abusive.
ABUSIVE = 1.25


def _scored(spark: SparkSession, base: str, columns: list[str]) -> DataFrame:
    docs = table(spark, base, "documents")
    return score(docs, train(docs, table(spark, base, "doc_labels")), columns)


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return _scored(spark, base, ["doc_id"]).filter(F.col("severity") >= ABUSIVE).select("doc_id").distinct()


def p10_scores(spark: SparkSession, base: str) -> DataFrame:
    return _scored(spark, base, ["doc_id", "source"])


def p10_rates(spark: SparkSession, base: str) -> DataFrame:
    """Per source: documents, abusive ones, their share and the mean severity."""
    bad = (F.col("severity") >= ABUSIVE).cast("bigint")
    return _scored(spark, base, ["source"]).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(bad).alias("n_abusive"), F.avg(bad).alias("rate"), F.avg("severity").alias("mean_severity"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
ORACLE: dict[str, str] = {}
