"""Distinct addresses per day, type and both (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import hexes as H
from blockloom.llm.distinct import build_runs, counts, grouping_sets, merge_runs
from blockloom.session import table, written

GROUPS = ["day_utc", "tx_type"]


def address_runs(spark: SparkSession, base: str) -> DataFrame:
    """Runs of sender, recipient and transaction hashes per day and type."""
    txns = table(spark, base, "txns")
    # hashed before the join: only 8 bytes of each identifier are shuffled
    ids = {s: F.when(c.isNotNull(), F.xxhash64(c)).alias(s) for s, c in (("from", H.address(F.col("from_addr"))), ("to", H.address(F.col("to_addr"))), ("tx", H.tx_hash(F.col("hash"))))}
    rows = txns.select(H.number_long(F.col("block_number")).alias("number"), H.number_key(F.col("tx_type")).alias("tx_type"), *ids.values()).filter("number is not null")
    days = table(spark, base, "blocks").groupBy("number").agg(F.min("block_timestamp").alias("at")).select("number", F.date_format("at", "yyyy-MM-dd").alias("day_utc"))
    # sizes of the groups: counted by number and type before the days are joined
    sizes = rows.groupBy("number", "tx_type").agg(F.count(F.lit(1)).alias("n")).join(days, "number").groupBy(*GROUPS).agg(F.sum("n").alias("n"))
    runs = build_runs(rows.join(days, "number").select(*GROUPS, *ids), GROUPS, {s: F.col(f"`{s}`") for s in ids}, hashed=True, sizes=sizes)
    return written(runs, "runs")


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    runs = address_runs(spark, base)
    days = merge_runs(grouping_sets(runs, GROUPS, [["day_utc"]]), GROUPS)
    every = runs.filter("tx_type is not null").select(*GROUPS, "side", "n").unionByName(days.select(*GROUPS, "side", "n"))
    n = every.groupBy(*GROUPS).agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("from", "to", "tx")])
    pairs = n.filter("tx >= 10").select(*GROUPS, "tx", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"`{s}`").alias("n")) for s in ("from", "to")])))
    return pairs.filter("n >= 0.75 * tx").select(*GROUPS, "side")


def p1_counts(spark: SparkSession, base: str) -> DataFrame:
    """All combinations of day and type, with the error bound."""
    runs = address_runs(spark, base).withColumn("tx_type", F.coalesce("tx_type", F.lit("none")))
    wider = merge_runs(grouping_sets(runs, GROUPS, [["day_utc"], ["tx_type"], []]), GROUPS)
    return counts(runs.select(*GROUPS, "side", "n").unionByName(wider.select(*GROUPS, "side", "n")), GROUPS)


def p1_runs(spark: SparkSession, base: str) -> DataFrame:
    """Hashes in the mergeable partial results, per day, type and side, after one more merge of the runs with themselves."""
    runs = address_runs(spark, base)
    again = merge_runs(runs.unionByName(runs), GROUPS)
    return again.groupBy(*GROUPS, "side").agg(F.sum("n").alias("n_hashes"), F.max(F.length("run") > 0).alias("coded"))


_ROWS = """
WITH d AS (SELECT number, strftime(min(block_timestamp), '%Y-%m-%d') day_utc FROM blocks GROUP BY 1),
t AS (SELECT day_utc, CASE WHEN tx_type IS NOT NULL THEN '0x' || coalesce(nullif(ltrim(regexp_replace(lower(tx_type), '^(0x|\\\\x)', ''), '0'), ''), '0') END tx_type,
  nullif(regexp_replace(lower(from_addr), '^(0x|\\\\x)', ''), '') f, nullif(regexp_replace(lower(to_addr), '^(0x|\\\\x)', ''), '') t, regexp_replace(lower(hash), '^(0x|\\\\x)', '') x
  FROM txns JOIN d ON d.number = TRY_CAST('0x' || regexp_replace(lower(block_number), '^(0x|\\\\x)', '') AS BIGINT))"""

QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p1_runs": p1_runs}
ORACLE = {
    "p1_found": _ROWS
    + """, g AS (SELECT day_utc, tx_type, count(DISTINCT f) f, count(DISTINCT t) t, count(DISTINCT x) x FROM t WHERE tx_type IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT day_utc, 'all', count(DISTINCT f), count(DISTINCT t), count(DISTINCT x) FROM t GROUP BY 1)
SELECT day_utc, tx_type, 'from' side FROM g WHERE x >= 10 AND f >= 0.75 * x UNION ALL SELECT day_utc, tx_type, 'to' FROM g WHERE x >= 10 AND t >= 0.75 * x""",
    "p1_runs": _ROWS
    + """, u AS (SELECT day_utc, tx_type, unnest(['from', 'to', 'tx']) side, unnest([f, t, x]) id FROM t)
SELECT day_utc, tx_type, side, count(DISTINCT id) n_hashes, true coded FROM u WHERE id IS NOT NULL GROUP BY 1, 2, 3""",
    "p1_counts": _ROWS
    + """, u AS (SELECT day_utc, coalesce(tx_type, 'none') tx_type, unnest(['from', 'to', 'tx']) side, unnest([f, t, x]) id FROM t),
g AS (SELECT coalesce(day_utc, 'all') day_utc, coalesce(tx_type, 'all') tx_type, side, count(DISTINCT id) n_distinct FROM u WHERE id IS NOT NULL GROUP BY GROUPING SETS ((day_utc, tx_type, side), (day_utc, side), (tx_type, side), (side)))
SELECT *, n_distinct::DOUBLE * (n_distinct - 1) / 36893488147419103232.0::DOUBLE expected_collisions, (n_distinct - 1)::DOUBLE / 36893488147419103232.0::DOUBLE relative_error FROM g""",
}
