import datetime

import pytest
from pyspark.sql import functions as F

from blockloom.functions import hexes as H
from blockloom.functions import ledger as L


def one(spark, fn, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_decode_hex(spark):
    got = one(spark, L.decode_hex, "0x00ff", "\\x00FF", "00ff", "0x0", "0x", "zz", None, "")
    assert [bytes(g) if g is not None else None for g in got] == [b"\x00\xff"] * 3 + [None, None, None, None, b""]


def test_hex_to_int(spark):
    got = one(spark, L.hex_to_int, "0xf4240", "0x7fffffffffffffff", "0x00", "ffffffffffffffff", "0x10000000000000000", "0x", "nope", None, "0x000000000000000000001f")
    assert [None if g is None else int(g) for g in got] == [1000000, 2**63 - 1, 0, 2**64 - 1, None, None, None, None, 31]


def test_u256(spark):
    big = "0x" + "f" * 64
    got = one(spark, L.hex_to_u256, big, "0x" + "f" * 63, "0x0", "0xff", "nope", None)
    assert got == [str(2**256 - 1), str(16**63 - 1), "0", "255", None, None]


def test_double(spark):
    got = one(spark, L.hex_to_double, "0x" + "f" * 64, "0x10", "0x", None)
    assert got[0] == pytest.approx(2.0**256) and got[1:] == [16.0, None, None]


def test_sizes(spark):
    assert one(spark, L.bytes_to_h, 2097152, 2**30, 2**50, 10, 0, None, kind="bigint") == ["2.00MB", "1.00GB", "1.00PB", "10.00B", "0.00B", None]


def test_json_add_key(spark):
    got = one(spark, lambda c: L.json_add_key(c, "k", F.lit("v")), '{"a": "b"}', '{"k": "old"}', "[1]", None)
    assert got == ['{"a":"b","k":"v"}', '{"k":"v"}', "[1]", None]


def test_time_and_topics(spark):
    assert one(spark, L.epoch_to_ts, 0, None, kind="bigint") == [datetime.datetime(1970, 1, 1), None]
    got = spark.sql("SELECT array('0x01') AS t").select(L.topic(F.col("t"), 0), L.topic(F.col("t"), 1)).first()
    assert bytes(got[0]) == b"\x01" and got[1] is None


def test_current_block(spark):
    L.register_current_block(spark, {"eth": 12})
    assert tuple(spark.sql("SELECT current_block('eth'), current_block('x'), current_block(NULL)").first()) == (12, None, None)
    L.register_current_block(spark, {})
    assert spark.sql("SELECT current_block('eth')").first()[0] is None


def test_spellings(spark):
    assert one(spark, H.address, "0xAB", "\\xab", "ab", "0x", "", None) == ["0xab"] * 3 + [None] * 3
    assert one(spark, H.number_key, "0x00a", "A", "0x0", "000", "0x", None) == ["0xa", "0xa", "0x0", "0x0", None, None]
    assert one(spark, H.number_long, "0x00a", "g", "0x" + "f" * 16, "0x0") == [10, None, None, 0]
    assert one(spark, H.long_key, 255, 0, None, kind="bigint") == ["0xff", "0x0", None]
