import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.llm import distinct as D
from blockloom.llm import frequent as Q

HASHES = st.lists(st.integers(0, 2**64 - 1), max_size=60).map(lambda x: np.array(sorted(set(x)), np.uint64))


@given(HASHES)
def test_round_trip(h):
    assert (D.decode(D.encode(h)) == h).all() and len(D.decode(D.encode(h))) == len(h)


@given(st.lists(st.integers(2**63, 2**64 - 1), min_size=1, max_size=9))
def test_round_trip_in_bucket(x):
    h = np.array(sorted(set(x)), np.uint64)
    assert (D.decode(D.encode(h, 1 << 63), 1 << 63) == h).all() and len(D.encode(h, 1 << 63)) <= len(D.encode(h))


@given(st.lists(HASHES, min_size=1, max_size=5))
def test_union(runs):
    assert D.union(runs).tolist() == sorted(set().union(*[r.tolist() for r in runs]))


def test_bits():
    assert D.bucket_bits(0) == D.bucket_bits(1 << 17) == 0 and D.bucket_bits(1 << 20) == 3 and D.bucket_bits(10**15) == 24


def brute(rows):
    out = {}
    for g, h, a, b in rows:
        for key in ((g, h), (g, "all"), ("all", h), ("all", "all")):
            for side, v in (("a", a), ("b", b)):
                if v is not None:
                    out.setdefault((*key, side), set()).add(v)
    return {k: len(v) for k, v in out.items()}


@pytest.mark.parametrize("bits", [0, 1, 5])
def test_distinct(spark, monkeypatch, bits):
    rnd = random.Random(bits)
    rows = [(rnd.choice(["x"] * 6 + ["y", "", None]), rnd.choice(["p", "q"]), rnd.choice([None, "", *map(str, range(80))]), str(rnd.randrange(500))) for _ in range(3000)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "g string, h string, a string, b string, side string, bucket int").repartition(7)
    monkeypatch.setattr(D, "CHUNK", 200)
    runs = D.build_runs(df, ["g", "h"], {"a": F.col("a"), "b": F.col("b")}, bits)
    merged = D.merge_runs(D.grouping_sets(runs, ["g", "h"], [["g", "h"], ["g"], ["h"], []]), ["g", "h"], bits)
    got = D.counts(merged, ["g", "h"]).collect()
    assert {(r.g, r.h, r.side): r.n_distinct for r in got} == brute(rows)
    assert all(r.expected_collisions < 1e-9 for r in got)
    # partial results merge again, in any grouping
    halves = [D.merge_runs(D.build_runs(part, ["g", "h"], {"a": F.col("a"), "b": F.col("b")}, bits), ["g", "h"], bits) for part in df.randomSplit([1.0, 1.0], 1)]
    again = D.merge_runs(halves[0].unionByName(halves[1]), ["g", "h"], bits)
    assert {(r.g, r.h, r.side): r.n_distinct for r in D.counts(again, ["g", "h"]).collect()} == {k: v for k, v in brute(rows).items() if "all" not in k}


def test_widths(spark):
    """Runs of any widths merge exactly, and a run's length follows from its own set."""
    def runs(ids, bits=None, per_run=64):
        df = spark.createDataFrame([("x" if i % 10 else "small", i) for i in ids], "g string, a bigint").repartition(3)
        return D.build_runs(df, ["g"], {"a": F.col("a")}, bits, per_run=per_run)

    same = D.merge_runs(runs(range(1000), 3).unionByName(runs(range(1000), 4)).unionByName(runs(range(500, 1500), 0)), ["g"], per_run=1 << 20)
    assert {(r.g, r.n_distinct) for r in D.counts(same, ["g"]).collect()} == {("x", 1350), ("small", 150)} and {r.bits for r in same.collect()} == {4}
    # whole and split runs in one task
    mixed = D.build_runs(spark.createDataFrame([("x" if i % 10 else "small", i) for i in range(1000)], "g string, a bigint"), ["g"], {"a": F.col("a")})
    one = D.merge_runs(D.grouping_sets(mixed.unionByName(runs(range(1000), 4)), ["g"], [["g"], []]).coalesce(1), ["g"], per_run=500)
    assert {(r.g, r.n_distinct) for r in D.counts(one, ["g"]).collect()} == {("x", 900), ("small", 100), ("all", 1000)}
    wider = D.merge_runs(runs(range(1000), 0), ["g"], per_run=64)
    assert {(r.g, r.bits) for r in wider.collect()} == {("x", 4), ("small", 1)}
    for n in (2000, 20_000):
        by = {g: [r.n for r in runs(range(n)).collect() if r.g == g] for g in ("x", "small")}
        assert sum(by["x"]) == n * 9 // 10 and sum(by["small"]) == n // 10
        assert all(32 <= sum(v) / len(v) <= 64 for v in by.values())
    tiny = runs(range(40)).collect()
    assert sorted((r.g, r.bits, r.n) for r in tiny) == [("small", 0, 4), ("x", 0, 36)]


def test_hot_value_leaves_a_task_once(spark):
    df = spark.range(10_000).select(F.lit("x").alias("g"), F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id")).alias("a")).repartition(4)
    runs = D.build_runs(df, ["g"], {"a": F.col("a")})
    assert [r.n for r in runs.collect()] == [3335]


def test_distinct_empty(spark):
    df = spark.createDataFrame([], "g string, a string")
    assert D.merge_runs(D.build_runs(df, ["g"], {"a": F.col("a")}, 2), ["g"], 2).count() == 0
    nulls = spark.createDataFrame([("x", None)], "g string, a string")
    assert D.build_runs(nulls, ["g"], {"a": F.col("a")}, 0).count() == 0


def test_sketch_never_low():
    rnd = np.random.default_rng(0)
    sketch, true = Q.Sketch(6, 3), Counter()
    for _ in range(30):
        keys, counts = np.unique(rnd.zipf(1.3, 200) % 1000, return_counts=True)
        h = (keys.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        est = sketch.add(h, counts)
        true.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        assert all(e >= true[k] for k, e in zip(keys.tolist(), est.tolist(), strict=True))


def test_heap():
    heap = Q.Heap(2)
    heap.offer(["a", "b", "c", "d", "e"], [5, 9, 1, 7, 8], [5, 9, 1, 7, 8])
    heap.trim()
    assert set(heap.held) == {"b", "e"} and heap.floor == 8
    heap.offer(["b", "f"], [10, 3], [1, 3])
    assert heap.held["b"] == (10, 10) and "f" not in heap.held


def values(spark, counts, side="s"):
    rows = [(side, v) for v, n in counts.items() for _ in range(n)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "side string, value string").repartition(5)


def test_candidates(spark, monkeypatch):
    monkeypatch.setattr(Q, "COMBINE", 50)
    counts = {"hot": 700, "warm": 60, "": 40, None: 30, **{f"v{i}": 1 + i % 3 for i in range(600)}}
    df = values(spark, counts).unionByName(values(spark, {"hot": 3}, "t"))
    for bits, size in ((16, 1000), (5, 20)):
        rows = Q.candidates(df, size, bits).collect()
        total = {r.side: r.lower for r in rows if r.value is None}
        assert total == {"s": sum(counts.values()), "t": 3}
        seen = {r.value: (r.lower, r.upper) for r in rows if r.side == "s" and r.value is not None}
        assert all(lo <= counts[v] <= hi for v, (lo, hi) in seen.items())
        assert {"hot", "warm"} <= set(seen)
        if bits == 16:
            assert {v: lo for v, (lo, hi) in seen.items()} == {v: n for v, n in counts.items() if v is not None}
        for threshold in (30, 60, 61):
            want = {("s", v) for v, n in counts.items() if v is not None and n >= threshold}
            found = Q.candidates(df, size, bits)
            assert {tuple(r) for r in Q.heavy(found.cache(), df, threshold).collect()} == want


@pytest.mark.parametrize("capacity", [50, 1000, 30_000])
def test_heavy_below_the_heaps(spark, capacity):
    """Far more values than the heaps hold reach the threshold: none is lost."""
    df = spark.range(60_000).select(F.lit("s").alias("side"), (F.col("id") % 20_000).cast("string").alias("value"))
    found = Q.candidates(df, capacity)
    assert Q.heavy(found, df, 3).count() == 20_000 and Q.heavy(found, df, 4).count() == 0


def test_candidates_empty(spark):
    assert Q.candidates(spark.createDataFrame([], "side string, value string")).count() == 0
