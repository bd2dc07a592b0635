"""Queries on incremental processing (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators.changes import Ledger, last_success, listing, process_changes, seen
from blockloom.session import few, scratch_path, table

KEY = ["table_name", "lower_bound"]
COMPARED = ["location", "byte_count", "row_count", "incomplete"]


def _changes(spark: SparkSession, base: str) -> DataFrame:
    """The batch that the next run processes, after a ledger that knows what the last successful runs have seen."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    return process_changes(ledger, "next", table(spark, base, "block_partitions"), last_success(table(spark, base, "run_log")), KEY, COMPARED)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return _changes(spark, base).select(*KEY)


def p5_changes(spark: SparkSession, base: str) -> DataFrame:
    return _changes(spark, base).select(*KEY, "entry_id", "recorded_at", *COMPARED)


def p5_batches(spark: SparkSession, base: str) -> DataFrame:
    """A batch for the successful runs of each month, and one for all entries after them.

    The runs' snapshots say what each batch lists. The second batch fails once after its
    rows are written, and once more after its commit; each time it is run again.
    """
    entries, runs = table(spark, base, "block_partitions"), table(spark, base, "run_log")
    good = runs.filter("job = 'index' AND status = 'succeeded' AND snapshot_at IS NOT NULL").withColumn("month", F.date_format("snapshot_at", "yyyy-MM"))
    months = sorted(r.month for r in few(good.select("month").distinct(), 10_000))
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    for i, batch in enumerate([*months, "next"]):
        snapshots = good.filter(F.col("month") <= batch).groupBy("table_name").agg(F.max("snapshot_at").alias("snapshot"))
        listed = listing(seen(entries, snapshots)[0] if batch != "next" else entries, KEY, COMPARED)
        for fail in ("write", "commit", "") if i == 1 else ("",):
            try:
                ledger.run(batch, listed, KEY, order=["recorded_at", "entry_id"], fail=fail)
            except RuntimeError:
                pass
    return ledger.manifest("table_name string, lower_bound bigint, location string, byte_count bigint, row_count bigint, incomplete boolean, batch string")


_NEWEST = "row_number() OVER (PARTITION BY table_name, lower_bound ORDER BY recorded_at DESC, entry_id DESC) = 1"
_CHANGES = f"""
WITH s AS (SELECT table_name, max(snapshot_at) s FROM run_log WHERE job = 'index' AND status = 'succeeded' GROUP BY 1),
now AS (SELECT * FROM block_partitions QUALIFY {_NEWEST}),
old AS (SELECT b.* FROM block_partitions b JOIN s USING (table_name) WHERE recorded_at <= s QUALIFY {_NEWEST})
SELECT {{}} FROM now n LEFT JOIN s USING (table_name) LEFT JOIN old o USING (table_name, lower_bound)
WHERE (s.s IS NULL OR n.recorded_at > s.s) AND (o.entry_id IS NULL OR n.location IS DISTINCT FROM o.location OR n.byte_count IS DISTINCT FROM o.byte_count
  OR n.row_count IS DISTINCT FROM o.row_count OR n.incomplete IS DISTINCT FROM o.incomplete)"""

# the batch of an entry is that of the first month whose runs have seen it; of each key and batch the newest entry counts, where it differs from the batch before
_BATCHES = """
WITH s AS (SELECT table_name, strftime(snapshot_at, '%Y-%m') batch, max(snapshot_at) s FROM run_log WHERE job = 'index' AND status = 'succeeded' GROUP BY 1, 2),
e AS (SELECT b.*, coalesce((SELECT min(s.batch) FROM s WHERE s.table_name = b.table_name AND s.s >= b.recorded_at), 'next') batch FROM block_partitions b),
n AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY table_name, lower_bound, batch ORDER BY recorded_at DESC, entry_id DESC) = 1),
d AS (SELECT table_name, lower_bound, location, byte_count, row_count, incomplete, batch,
  row(location, byte_count, row_count, incomplete) AS now, lag(row(location, byte_count, row_count, incomplete)) OVER (PARTITION BY table_name, lower_bound ORDER BY batch) AS old FROM n)
SELECT * EXCLUDE (now, old) FROM d WHERE old IS NULL OR now IS DISTINCT FROM old"""

QUERIES = {"p5_found": p5_found, "p5_changes": p5_changes, "p5_batches": p5_batches}
ORACLE = {
    "p5_found": _CHANGES.format("n.table_name, n.lower_bound"),
    "p5_changes": _CHANGES.format("n.table_name, n.lower_bound, n.entry_id, n.recorded_at, n.location, n.byte_count, n.row_count, n.incomplete"),
    "p5_batches": _BATCHES,
}
