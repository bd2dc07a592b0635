"""Queries on small files (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators.compaction import Rewrite, compact_folder, plan_merges
from blockloom.session import scratch_path, table


#: Rows of the tiny files that the manifest table is stored as before it is compacted.
TINY = 25


def _compacted(spark: SparkSession, base: str) -> tuple[DataFrame, Rewrite]:
    """The whole manifest table, stored as tiny files (the test table is one file), compacted."""
    tiny = scratch_path(spark, "tiny")
    table(spark, base, "block_partitions").write.option("maxRecordsPerFile", TINY).parquet(tiny)
    return compact_folder(spark, tiny)


def p7_method(spark: SparkSession, base: str) -> DataFrame:
    """The manifest table after split packing of its tiny files, verified."""
    return _compacted(spark, base)[0]


def p7_rewrite(spark: SparkSession, base: str) -> DataFrame:
    """What the compaction reports: rows, and that there are fewer files and fewer bytes, and no file too many."""
    done = _compacted(spark, base)[1]
    row = (done.rows, done.files_before >= done.rows // TINY > 1, done.files_after < done.files_before, done.bytes_after < done.bytes_before, done.files_after <= 1 + done.bytes_before // (128 << 20))
    return spark.createDataFrame([row], "n_rows bigint, many_before boolean, fewer_files boolean, fewer_bytes boolean, well_sized boolean")


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return plan_merges(table(spark, base, "block_partitions")).select("entry_id")


def p7_plan(spark: SparkSession, base: str) -> DataFrame:
    return plan_merges(table(spark, base, "block_partitions"))


def p7_bins(spark: SparkSession, base: str) -> DataFrame:
    return plan_merges(table(spark, base, "block_partitions")).groupBy("table_name", "bin").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"), F.min("lower_bound").alias("first_block"))


_LIVE = """
WITH live AS (SELECT *, coalesce(byte_count, 200 * row_count) size FROM block_partitions
  QUALIFY row_number() OVER (PARTITION BY table_name, lower_bound ORDER BY recorded_at DESC, entry_id DESC) = 1),
plan AS (SELECT table_name, lower_bound, entry_id, location, size, row_count,
  (coalesce(sum(size + 16384) OVER (PARTITION BY table_name ORDER BY lower_bound, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 134217728)::BIGINT bin
  FROM live WHERE NOT coalesce(incomplete, false) AND size < 1000000)"""

QUERIES = {"p7_method": p7_method, "p7_rewrite": p7_rewrite, "p7_found": p7_found, "p7_plan": p7_plan, "p7_bins": p7_bins}
ORACLE = {
    "p7_method": "SELECT * FROM block_partitions",
    "p7_rewrite": "SELECT count(*) n_rows, true many_before, true fewer_files, true fewer_bytes, true well_sized FROM block_partitions",
    "p7_found": _LIVE + " SELECT entry_id FROM plan",
    "p7_plan": _LIVE + " SELECT *, printf('compacted/%s/%08d.parquet', table_name, bin) target_location FROM plan",
    "p7_bins": _LIVE + " SELECT table_name, bin, count(*) n_files, sum(size)::BIGINT bytes, min(lower_bound) first_block FROM plan GROUP BY 1, 2",
}
