"""Most frequent senders and recipients (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.functions import hexes as H
from blockloom.llm.frequent import candidates, heavy
from blockloom.session import table


def _values(spark: SparkSession, base: str) -> DataFrame:
    """One row per transaction and side; the rows of one transaction agree, so one is kept."""
    once = table(spark, base, "txns").select(F.xxhash64(H.tx_hash(F.col("hash"))).alias("tx"), H.address(F.col("from_addr")).alias("from"), H.address(F.col("to_addr")).alias("to")).distinct()
    return once.select(F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"`{s}`").alias("value")) for s in ("from", "to")])))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    values = _values(spark, base)
    found = candidates(values)
    total = found.filter("value is null").agg(F.max("lower")).first()[0] or 0
    return heavy(found, values, 0.01 * total).select("side", F.col("value").alias("address"))


def p2_top(spark: SparkSession, base: str) -> DataFrame:
    """The 100 heaviest addresses of each side with their bounds; ties by address."""
    best = W.partitionBy("side").orderBy(F.desc("upper"), "value")
    # each task ranks its own heaps first (a group limit), so one task per side ranks at most tasks x 100 rows
    return candidates(_values(spark, base)).filter("value is not null").withColumn("place", F.row_number().over(best)).filter("place <= 100").withColumnRenamed("value", "address")


_A = "'0x' || nullif(regexp_replace(lower({}), '^(0x|\\\\x)', ''), '')"

QUERIES = {"p2_found": p2_found, "p2_top": p2_top}
ORACLE = {
    "p2_found": f"""
WITH t AS (SELECT DISTINCT regexp_replace(lower(hash), '^(0x|\\\\x)', '') x, {_A.format('from_addr')} f, {_A.format('to_addr')} t FROM txns),
g AS (SELECT 'from' side, f address, count(*) n FROM t GROUP BY 2 UNION ALL SELECT 'to', t, count(*) FROM t GROUP BY 2)
SELECT side, address FROM g WHERE address IS NOT NULL AND n >= 0.01 * (SELECT count(DISTINCT x) FROM t)""",
}
