"""Queries that must cover the whole input, whatever its size."""

import json

import pytest
from oracle import compare
from pyspark.sql import functions as F

from blockloom.operators import orphans
from blockloom.operators.orphans import Records, Target, find_orphans
from blockloom.queries import engine_queries as Q
from blockloom.sources.manifest import ROW
from blockloom.sources.storage import StorageConf, Store


def head(spark, data) -> int:
    return spark.read.parquet(f"{data}/blocks.parquet").agg(F.max("number")).first()[0]


def test_range_source_reaches_the_head(spark, data):
    n = head(spark, data)
    got = Q.range_source(spark, data).agg(F.count("*"), F.countDistinct("number"), F.min("number"), F.max("number")).first()
    assert tuple(got) == (n + 1, n + 1, 0, n)


def test_chunked_range_reaches_the_head(spark, data):
    n = head(spark, data)
    rows = sorted(Q.chunked_range(spark, data).collect())
    assert [r.first for r in rows] == [0, *[r.last + 1 for r in rows[:-1]]] and rows[-1].last == n
    assert all(r.n == r.last - r.first + 1 for r in rows) and max(r.n for r in rows) - min(r.n for r in rows) <= 1


def test_manifest_keeps_every_field(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "_store", lambda spark, name: Store(spark, StorageConf("file", str(tmp_path))))
    Q.manifest_round_trip(spark, data).collect()
    head = json.loads((tmp_path / "index.json").read_text())
    texts = [json.dumps(p) for t in head["tables"] for p in t["partitions"]]
    texts += [x for f in tmp_path.rglob("part-*.json") for x in f.read_text().splitlines()]
    saved = spark.createDataFrame([(x,) for x in texts], "x string").select(F.from_json("x", ROW).alias("p")).select("p.*")
    sql = f"""SELECT table_name "table", lower_bound, location, created_at, byte_count, row_count, coalesce(incomplete, false) incomplete FROM {Q._LIVE_ENTRIES}"""
    _, ours, theirs = compare(saved, sql, data)
    assert not ours and not theirs


def test_manifest_of_more_than_a_million_files(spark, tmp_path):
    n = 1_000_003
    rows = spark.range(n).selectExpr("id AS entry_id", "'logs' AS table_name", "id * 5 AS lower_bound", "concat('f/', id) AS location", "TIMESTAMP_NTZ'2024-01-01 00:00:00.123456' AS created_at", "id AS byte_count", "1L AS row_count", "false AS incomplete", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS recorded_at")
    rows.write.parquet(f"{tmp_path}/block_partitions.parquet")
    got = Q.manifest_round_trip(spark, str(tmp_path)).agg(F.count("*"), F.countDistinct("lower_bound"), F.max("lower_bound")).first()
    assert tuple(got) == (n, n, 5 * (n - 1))


def test_manifest_refuses_a_crooked_bound(spark, tmp_path):
    spark.range(3).selectExpr("id AS entry_id", "'logs' AS table_name", "id AS lower_bound", "'f' AS location", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS created_at", "id AS byte_count", "1L AS row_count", "false AS incomplete", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS recorded_at").write.parquet(f"{tmp_path}/block_partitions.parquet")
    with pytest.raises(Exception, match="is no multiple of 5"):
        Q.manifest_round_trip(spark, str(tmp_path))


def test_orphans_are_inherited_to_any_depth(spark, monkeypatch):
    # one file a round, or the small rounds take minutes
    whole = orphans.written
    monkeypatch.setattr(orphans, "written", lambda df, name: whole(df.coalesce(1), name))
    n = 54
    rows = spark.createDataFrame([(i, str(i - 1), None) for i in range(1, n + 1)], "id bigint, parent string, at timestamp_ntz").coalesce(1)
    own = F.col("id").cast("string")
    found = find_orphans(spark, [Records("t", rows, F.col("id"), F.col("at"), {"parent": ("t", F.col("parent"))}, ("t", own))], [Target("t", rows, own, F.col("at"))])
    assert sorted((r.child_id, r.kind, r.depth) for r in found.collect()) == [(i, "direct" if i == 1 else "inherited", i - 1) for i in range(1, n + 1)]
