"""Queries on hot keys (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import hexes as H
from blockloom.operators.hot_keys import eager_join, marked_pairs, rollup_pairs, segment_pairs
from blockloom.session import table


def _rows(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "txns").select(
        H.address(F.col("to_addr")).alias("key"), H.number_long(F.col("block_number")).alias("pos"), H.number_long(F.col("transaction_index")).alias("sub"),
        H.tx_hash(F.col("hash")).alias("id"), H.address(F.col("from_addr")).alias("mark"),
    )


def _pairs(spark: SparkSession, base: str) -> DataFrame:
    """Per recipient: its transaction rows times the log rows it emitted."""
    incoming = table(spark, base, "txns").select(H.address(F.col("to_addr")).alias("address"), H.number_long(F.col("gas")).alias("gas"))
    emitted = table(spark, base, "logs").select(H.bytes_key(F.col("contract_address")).alias("address"), F.length("data").cast("bigint").alias("bytes"))
    return eager_join(incoming, emitted, "address", {"pair_gas": F.col("gas")}, {"pair_bytes": F.col("bytes")})


def p6_method(spark: SparkSession, base: str) -> DataFrame:
    return _pairs(spark, base).select("address", "n_left", "n_right", *[F.col(c).cast("bigint").alias(c) for c in ("n_pairs", "pair_gas", "pair_bytes")])


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return segment_pairs(_rows(spark, base)).select(F.col("id").alias("tx_hash")).distinct()


def p6_recipients(spark: SparkSession, base: str) -> DataFrame:
    """Per recipient: its transactions and how many of them follow closely on one of the same sender."""
    marked = marked_pairs(_rows(spark, base))
    return marked.groupBy(F.col("key").alias("address")).agg(F.count(F.lit(1)).alias("n_txns"), F.count_if("found").alias("n_found"))


def p6_rollup(spark: SparkSession, base: str) -> DataFrame:
    """Pairs by the size of the address, rolled up from the joined states."""
    per = _pairs(spark, base)
    decade = F.length((F.col("n_left") + F.col("n_right")).cast("string"))
    return rollup_pairs(per, decade, ["pair_gas", "pair_bytes"]).select("grp", "n_keys", *[F.col(c).cast("bigint").alias(c) for c in ("n_pairs", "pair_gas", "pair_bytes")])


_D = "regexp_replace(lower({}), '^(0x|\\\\x)', '')"
_ADDR = "'0x' || nullif(" + _D + ", '')"
_LONG = "('0x' || " + _D + ")::BIGINT"
_PAIRS = f"""
WITH i AS (SELECT {_ADDR.format('to_addr')} address, count(*) n, sum({_LONG.format('gas')}) g FROM txns GROUP BY 1),
o AS (SELECT '0x' || lower(hex(contract_address)) address, count(*) n, sum(octet_length(data)) b FROM logs GROUP BY 1),
p AS (SELECT address, i.n n_left, coalesce(o.n, 0) n_right, i.n * coalesce(o.n, 0) n_pairs, (i.g * coalesce(o.n, 0))::BIGINT pair_gas, (coalesce(o.b, 0) * i.n)::BIGINT pair_bytes
  FROM i LEFT JOIN o USING (address) WHERE address IS NOT NULL)"""

_ORDERED = f"""
WITH t AS (SELECT DISTINCT '0x' || {_D.format('hash')} tx_hash, {_ADDR.format('to_addr')} k, {_ADDR.format('from_addr')} m,
  {_LONG.format('block_number')} b, {_LONG.format('transaction_index')} x FROM txns),
w AS (SELECT *, lag(m) OVER k pm, lag(b) OVER k pb FROM t WHERE k IS NOT NULL WINDOW k AS (PARTITION BY k ORDER BY b, x, tx_hash))"""

QUERIES = {"p6_method": p6_method, "p6_found": p6_found, "p6_recipients": p6_recipients, "p6_rollup": p6_rollup}
ORACLE = {
    "p6_method": _PAIRS + " SELECT * FROM p",
    "p6_found": _ORDERED + " SELECT DISTINCT tx_hash FROM w WHERE pm = m AND b - pb <= 3",
    "p6_recipients": _ORDERED + " SELECT k address, count(*) n_txns, count(*) FILTER (pm = m AND b - pb <= 3) n_found FROM w GROUP BY 1",
    "p6_rollup": _PAIRS + " SELECT length((n_left + n_right)::VARCHAR)::INT grp, count(*) n_keys, sum(n_pairs)::BIGINT n_pairs, sum(pair_gas)::BIGINT pair_gas, sum(pair_bytes)::BIGINT pair_bytes FROM p GROUP BY 1",
}
