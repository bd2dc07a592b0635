"""Queries on broken references (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import hexes as H
from blockloom.operators.orphans import Records, Target, find_orphans, orphan_report
from blockloom.session import table


def ledger_graph(spark: SparkSession, base: str) -> tuple[list[Records], list[Target]]:
    """txns -> blocks (hash, number) and logs -> blocks (hash, number), txns (hash)."""
    blocks, removed, txns, logs = (table(spark, base, n) for n in ("blocks", "removed_blocks", "txns", "logs"))
    records = [
        Records("txns", txns, F.col("txn_id"), F.col("ingested_at"), {"block_hash": ("block_hash", H.tx_hash(F.col("block_hash"))), "block_number": ("block_number", H.number_key(F.col("block_number")))}, ("tx_hash", H.tx_hash(F.col("hash")))),
        Records("logs", logs, F.col("log_id"), F.col("ingested_at"), {"block_hash": ("block_hash", H.bytes_key(F.col("block_hash"))), "block_number": ("block_number", H.long_key(F.col("block_number"))), "tx_hash": ("tx_hash", H.bytes_key(F.col("tx_hash")))}),
    ]
    targets = [
        Target("block_hash", blocks, H.bytes_key(F.col("hash")), F.col("ingested_at")),
        Target("block_hash", removed, H.bytes_key(F.col("hash")), gone=True),
        Target("block_number", blocks, H.long_key(F.col("number")), F.col("ingested_at")),
        Target("tx_hash", txns, H.tx_hash(F.col("hash")), F.col("ingested_at")),
    ]
    return records, targets


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    records, targets = ledger_graph(spark, base)
    return find_orphans(spark, records, targets).filter("kind = 'direct'").select("child_table", "child_id", "ref", "status")


def p3_cascade(spark: SparkSession, base: str) -> DataFrame:
    records, targets = ledger_graph(spark, base)
    return find_orphans(spark, records, targets)


def p3_report(spark: SparkSession, base: str) -> DataFrame:
    records, targets = ledger_graph(spark, base)
    return orphan_report(find_orphans(spark, records, targets), records)


_HASH = "'0x' || regexp_replace(lower({}), '^(0x|\\\\x)', '')"
_NUM = "'0x' || coalesce(nullif(ltrim(regexp_replace(lower({}), '^(0x|\\\\x)', ''), '0'), ''), '0')"

_DIRECT = f"""
WITH refs AS (
  SELECT 'txns' child_table, txn_id child_id, ingested_at arr, unnest([
    {{'ref': 'block_hash', 'key': {_HASH.format('block_hash')}}},
    {{'ref': 'block_number', 'key': {_NUM.format('block_number')}}}], recursive := true) FROM txns
  UNION ALL
  SELECT 'logs', log_id, ingested_at, unnest([
    {{'ref': 'block_hash', 'key': '0x' || lower(hex(block_hash))}},
    {{'ref': 'block_number', 'key': '0x' || lower(to_hex(block_number))}},
    {{'ref': 'tx_hash', 'key': '0x' || lower(hex(tx_hash))}}], recursive := true) FROM logs),
targets AS (
  SELECT 'block_hash' ref, '0x' || lower(hex(hash)) key, min(ingested_at) first FROM blocks GROUP BY 2
  UNION ALL SELECT 'block_number', '0x' || lower(to_hex(number)), min(ingested_at) FROM blocks GROUP BY 2
  UNION ALL SELECT 'tx_hash', {_HASH.format('hash')}, min(ingested_at) FROM txns GROUP BY 2),
gone AS (SELECT DISTINCT '0x' || lower(hex(hash)) key FROM removed_blocks),
direct AS (
  SELECT DISTINCT child_table, child_id, r.ref, CASE
    WHEN r.ref = 'block_hash' AND g.key IS NOT NULL THEN 'deleted'
    WHEN t.key IS NULL THEN 'missing' WHEN t.first > r.arr THEN 'late' END status
  FROM refs r LEFT JOIN targets t ON t.ref = r.ref AND t.key = r.key LEFT JOIN gone g ON g.key = r.key)"""

_CASCADE = (
    _DIRECT
    + f""",
down AS (
  SELECT {_HASH.format('hash')} key FROM txns t
  LEFT JOIN (SELECT DISTINCT child_id FROM direct WHERE child_table = 'txns' AND status IN ('missing', 'deleted')) d ON d.child_id = t.txn_id
  GROUP BY 1 HAVING bool_and(d.child_id IS NOT NULL)),
orphans AS (
  SELECT child_table, child_id, ref, status, 'direct' kind, 0::INT depth FROM direct WHERE status IS NOT NULL
  UNION ALL
  SELECT 'logs', l.log_id, 'tx_hash', 'inherited', 'inherited', 1::INT FROM logs l
  WHERE '0x' || lower(hex(l.tx_hash)) IN (SELECT key FROM down)
    AND l.log_id NOT IN (SELECT child_id FROM direct WHERE child_table = 'logs' AND ref = 'tx_hash' AND status IS NOT NULL))"""
)

QUERIES = {"p3_found": p3_found, "p3_cascade": p3_cascade, "p3_report": p3_report}
ORACLE = {
    "p3_found": _DIRECT + " SELECT child_table, child_id, ref, status FROM direct WHERE status IS NOT NULL",
    "p3_cascade": _CASCADE + " SELECT * FROM orphans",
    "p3_report": _CASCADE
    + """ SELECT o.child_table, strftime(date_trunc('month', a.arr), '%Y-%m-%d') period, o.ref, o.status, o.kind, count(*) n_refs, count(DISTINCT o.child_id) n_records
FROM orphans o JOIN (SELECT DISTINCT child_table, child_id, arr FROM refs) a USING (child_table, child_id) GROUP BY ALL""",
}
