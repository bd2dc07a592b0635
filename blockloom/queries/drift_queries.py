"""Queries on drifting schemas (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators.drift import profiles, schema_changes, unify, versions
from blockloom.session import table, written

FIELDS = ["blockHash", "blockNumber", "from", "gas", "gasPrice", "hash", "input", "nonce", "to", "transactionIndex", "value", "type", "chainId", "v", "r", "s"]


def _inputs(spark: SparkSession, base: str):
    files, records, names = (table(spark, base, n) for n in ("raw_files", "raw_txns", "field_names"))
    return files, records, names, written(profiles(records, names), "profile")  # a row per file, name and type; read several times


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    files, _, names, profile = _inputs(spark, base)
    return schema_changes(files, profile, names).select("file_id", "field", "change_kind").distinct()


def p4_table(spark: SparkSession, base: str) -> DataFrame:
    """All records in one table; the fields it does not list and the issues as sorted texts."""
    files, records, _, profile = _inputs(spark, base)
    whole = unify(records, versions(files, profile, FIELDS), FIELDS)
    rest = F.array_join(F.array_sort(F.transform(F.map_entries("rest"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return whole.withColumn("rest", rest).withColumn("issues", F.array_join(F.array_sort("issues"), ";"))


def p4_profile(spark: SparkSession, base: str) -> DataFrame:
    return _inputs(spark, base)[3]


def p4_versions(spark: SparkSession, base: str) -> DataFrame:
    files, _, _, profile = _inputs(spark, base)
    return versions(files, profile).select("file_id", "feed", "file_seq", "prev_id", "fingerprint", "version")


def p4_steps(spark: SparkSession, base: str) -> DataFrame:
    """The explicit steps from each version to its feed's next, and the chained steps of its files."""
    files, _, _, profile = _inputs(spark, base)
    return versions(files, profile, FIELDS).select("feed", "version", "fingerprint", "migration", "steps").distinct()


_PROFILE = """
WITH k AS (SELECT file_id, payload, unnest(json_keys(payload)) AS name FROM raw_txns),
t AS (SELECT file_id, name, json_type(payload, '$."' || name || '"') jt FROM k),
profile AS (SELECT file_id, coalesce(f.field, t.name) field, t.name, CASE jt WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'UBIGINT' THEN 'bigint' WHEN 'HUGEINT' THEN 'bigint'
    WHEN 'DOUBLE' THEN 'double' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END type, count(*) n
  FROM t LEFT JOIN field_names f ON f.known_name = t.name WHERE jt IS NOT NULL AND jt <> 'NULL' GROUP BY ALL)"""

_FOUND = (
    _PROFILE
    + """,
sets AS (SELECT file_id, field, list_sort(list(DISTINCT name)) names, list_sort(list(DISTINCT type)) types, list_sort(list(DISTINCT name || ':' || type)) pairs FROM profile GROUP BY 1, 2),
prev AS (SELECT file_id, lag(file_id) OVER (PARTITION BY feed ORDER BY file_seq, file_id) prev_id FROM raw_files),
a AS (SELECT p.file_id, s.* EXCLUDE (file_id) FROM prev p JOIN sets s USING (file_id) WHERE prev_id IS NOT NULL),
b AS (SELECT p.file_id, s.* EXCLUDE (file_id) FROM prev p JOIN sets s ON s.file_id = p.prev_id),
ab AS (SELECT coalesce(a.file_id, b.file_id) file_id, coalesce(a.field, b.field) field, a.names an, b.names bn, a.types aty, b.types bty FROM a FULL JOIN b ON a.file_id = b.file_id AND a.field = b.field),
d0 AS (SELECT file_id, unnest(from_json(declared_schema->'$.fields', '[{"name":"VARCHAR","type":"VARCHAR"}]'), recursive := true) FROM raw_files WHERE declared_schema IS NOT NULL),
d AS (SELECT file_id, coalesce(f.field, d0.name) field, list_sort(list(DISTINCT d0.name || ':' || d0.type)) pairs FROM d0 LEFT JOIN field_names f ON f.known_name = d0.name GROUP BY 1, 2),
s AS (SELECT * FROM sets WHERE file_id IN (SELECT file_id FROM raw_files WHERE declared_schema IS NOT NULL))
SELECT file_id, field, 'added' change_kind FROM ab WHERE bn IS NULL
UNION ALL SELECT file_id, field, 'removed' FROM ab WHERE an IS NULL
UNION ALL SELECT file_id, field, 'renamed' FROM ab WHERE an <> bn
UNION ALL SELECT file_id, field, 'type_changed' FROM ab WHERE aty <> bty
UNION ALL SELECT coalesce(d.file_id, s.file_id), coalesce(d.field, s.field), 'declared_differs' FROM d FULL JOIN s ON d.file_id = s.file_id AND d.field = s.field WHERE d.pairs IS DISTINCT FROM s.pairs"""
)

QUERIES = {"p4_found": p4_found, "p4_table": p4_table, "p4_profile": p4_profile, "p4_versions": p4_versions, "p4_steps": p4_steps}
_VERSIONS = (
    _PROFILE
    + """,
shape AS (SELECT file_id, to_json(list_sort(list(DISTINCT [field, name, type])))::VARCHAR t FROM profile GROUP BY 1),
f AS (SELECT file_id, feed, file_seq, sha256(coalesce(t, '[]')) fingerprint FROM raw_files LEFT JOIN shape USING (file_id)),
l AS (SELECT *, lag(file_id) OVER w prev_id, lag(fingerprint) OVER w pf FROM f WINDOW w AS (PARTITION BY feed ORDER BY file_seq, file_id)),
vers AS (SELECT file_id, feed, file_seq, prev_id, fingerprint, (sum(CASE WHEN pf = fingerprint THEN 0 ELSE 1 END) OVER (PARTITION BY feed ORDER BY file_seq, file_id))::BIGINT version FROM l)"""
)

# numbers with a fraction stay as written, whole ones become hex; the field's own name wins, else the first
_TABLE = (
    _VERSIONS
    + """,
r AS (SELECT record_id, unnest(json_keys(payload)) AS name, generate_subscripts(json_keys(payload), 1) place, payload FROM raw_txns),
v AS (SELECT record_id, coalesce(f.field, r.name) field, r.name, place, json_extract(payload, '$."' || r.name || '"') x, json_type(payload, '$."' || r.name || '"') jt FROM r LEFT JOIN field_names f ON f.known_name = r.name),
c AS (SELECT *, CASE WHEN jt = 'VARCHAR' THEN x->>'$' WHEN jt IN ('BIGINT', 'UBIGINT') AND x::VARCHAR NOT LIKE '-%' THEN '0x' || lower(to_hex(x::VARCHAR::UBIGINT)) WHEN jt = 'OBJECT' AND json_type(x, '$.hex') = 'VARCHAR' THEN x->>'$.hex' ELSE x::VARCHAR END t,
  jt = 'VARCHAR' OR (jt IN ('BIGINT', 'UBIGINT') AND x::VARCHAR NOT LIKE '-%') OR (jt = 'OBJECT' AND json_type(x, '$.hex') = 'VARCHAR') fits FROM v WHERE jt <> 'NULL'),
one AS (SELECT record_id, field, arg_min(t, (name <> field)::INT * 1000 + place) t FROM c GROUP BY 1, 2),
bad AS (SELECT record_id, 'cast:' || field issue FROM c WHERE NOT fits UNION ALL SELECT record_id, 'clash:' || field FROM c GROUP BY record_id, field HAVING count(DISTINCT t) > 1),
issues AS (SELECT record_id, string_agg(issue, ';' ORDER BY issue) issues FROM bad GROUP BY 1),
rest AS (SELECT record_id, string_agg(field || '=' || t, ';' ORDER BY field || '=' || t) rest FROM one WHERE field NOT IN ({names}) GROUP BY 1),
wide AS (SELECT record_id, {cols} FROM one GROUP BY 1)
SELECT t.record_id, t.file_id, t.line_no, vers.version, {outs}, coalesce(rest, '') rest, coalesce(issues, '') issues
FROM raw_txns t LEFT JOIN vers USING (file_id) LEFT JOIN wide USING (record_id) LEFT JOIN rest USING (record_id) LEFT JOIN issues USING (record_id)""".format(
        names=", ".join(f"'{f}'" for f in FIELDS), cols=", ".join(f"max(t) FILTER (field = '{f}') \"{f}\"" for f in FIELDS), outs=", ".join(f'wide."{f}"' for f in FIELDS)
    )
)

ORACLE = {
    "p4_found": _FOUND,
    "p4_profile": _PROFILE + " SELECT * FROM profile",
    "p4_versions": _VERSIONS + " SELECT * FROM vers",
    "p4_table": _TABLE,
}
