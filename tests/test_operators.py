import datetime
import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.operators.changes import Ledger, checksum, file_listing, last_success, newest, process_changes
from blockloom.operators.compaction import compact_folder, fingerprint, plan_merges
from blockloom.operators.drift import canonical, collapse, json_type, migration, profiles, read_record, schema_changes, to_text, unify, versions
from blockloom.operators.hot_keys import eager_join, rollup_pairs, segment_pairs
from blockloom.operators.orphans import Records, Target, direct_orphans, find_orphans, orphan_report

T0 = datetime.datetime(2024, 1, 1)


def at(n):
    return None if n is None else T0 + datetime.timedelta(hours=n)


# ---- orphans


def graph(spark, blocks, removed, txns, logs):
    b = spark.createDataFrame([(h, at(t)) for h, t in blocks], "h string, at timestamp_ntz")
    r = spark.createDataFrame([(h,) for h in removed], "h string")
    t = spark.createDataFrame([(i, h, b_, at(x), "extra") for i, h, b_, x in txns], "id bigint, h string, b string, at timestamp_ntz, status string")
    g = spark.createDataFrame([(i, x_, p, at(a)) for i, x_, p, a in logs], "id bigint, x string, p string, at timestamp_ntz")
    c = F.col
    records = [Records("txns", t, c("id"), c("at"), {"b": ("b", c("b"))}, ("x", c("h"))), Records("logs", g, c("id"), c("at"), {"x": ("x", c("x")), "p": ("l", c("p"))}, ("l", c("id").cast("string")))]
    targets = [Target("b", b, c("h"), c("at")), Target("b", r, c("h"), gone=True), Target("x", t, c("h"), c("at")), Target("l", g, c("id").cast("string"), c("at"))]
    return records, targets


def test_orphans(spark):
    records, targets = graph(
        spark,
        [("a", 1), ("a", 5), ("late", 9), ("nul", None), (None, 1)], ["gone", "gone"],
        [(1, "t1", "a", 2), (2, "t2", "late", 2), (3, "t3", "none", 2), (4, "t4", "gone", 2), (5, "t5", None, 2), (6, "t6", "nul", 2), (3, "t3", "none", 2), (7, "t7", "a", 2), (8, "t7", "none", 2), (9, "t9", "late", None)],
        [(10, "t3", None, 3), (11, "t1", "10", 3), (12, "t7", "11", 3), (13, "none", "13", 3), (14, "t1", "15", 3), (15, "t1", "14", 3)],
    )
    rows = find_orphans(spark, records, targets).collect()
    direct = {(r.child_table, r.child_id, r.ref, r.status) for r in rows if r.kind == "direct"}
    assert direct == {("txns", 2, "b", "late"), ("txns", 3, "b", "missing"), ("txns", 4, "b", "deleted"), ("txns", 8, "b", "missing"), ("logs", 13, "x", "missing")}
    down = {(r.child_table, r.child_id, r.ref, r.depth) for r in rows if r.kind == "inherited"}
    # t7 has one sound row, so log 12 inherits from log 11 only
    assert down == {("logs", 10, "x", 1), ("logs", 13, "p", 1), ("logs", 11, "p", 2), ("logs", 12, "p", 3)}
    report = orphan_report(find_orphans(spark, records, targets), records).collect()
    assert sum(r.n_refs for r in report) == len(rows)


def test_orphan_cycle_and_empty(spark):
    records, targets = graph(spark, [], [], [], [(1, None, "2", 1), (2, "no", "1", 1)])
    got = {(r.child_id, r.ref, r.kind, r.depth) for r in find_orphans(spark, records, targets).collect()}
    assert got == {(2, "x", "direct", 0), (1, "p", "inherited", 1), (2, "p", "inherited", 2)}
    records, targets = graph(spark, [], [], [], [])
    assert find_orphans(spark, records, targets).count() == 0 and direct_orphans(records, targets).count() == 0


# ---- increments

ENTRY = "entry_id bigint, table_name string, lower_bound bigint, location string, byte_count bigint, row_count bigint, incomplete boolean, recorded_at timestamp_ntz, snapshot string, checksum string"
KEY, COMPARED = ["table_name", "lower_bound"], ["location", "byte_count", "row_count", "incomplete"]


def entries(spark, rows):
    return spark.createDataFrame([(i, t, lo, loc, b, r, inc, at(x), "clash", "clash") for i, t, lo, loc, b, r, inc, x in rows], ENTRY)


def changed(spark, folder, rows, runs):
    runs = spark.createDataFrame([(t, j, s, at(x)) for t, j, s, x in runs], "table_name string, job string, status string, snapshot_at timestamp_ntz")
    ledger = Ledger(spark, f"file://{folder}/{len(rows)}-{len(list(folder.iterdir()))}")
    found = process_changes(ledger, "b", entries(spark, rows), last_success(runs), KEY, COMPARED)
    # a repeated run finds nothing to do, and the batch stays
    assert ledger.run("b", entries(spark, rows), KEY) == 0 and ledger.committed() == ["seen", "b"]
    return sorted((r.table_name, r.lower_bound) for r in found.select(*KEY).collect())


def test_changes(spark, tmp_path):
    rows = [
        (1, "a", 0, "x", 1, 1, False, 1), (2, "a", 0, "x", 1, 1, False, 9), (3, "a", 5, "x", 1, 1, False, 1), (4, "a", 5, "x", None, 1, False, 9), (5, "a", 10, "n", 1, 1, False, 9),
        (6, "a", 15, "x", None, None, None, 1), (7, "a", 15, "x", None, None, None, 9), (8, "a", 20, "old", 1, 1, False, 5), (9, "b", 0, "x", 1, 1, False, 1),
        (10, "a", 25, "x", 1, 1, False, 1), (11, "a", 25, "y", 1, 1, False, 8), (12, "a", 25, "x", 1, 1, False, 9), (13, "a", 30, "x", 1, 1, False, None), (5, "a", 10, "n", 1, 1, False, 9),
    ]
    runs = [("a", "index", "succeeded", 5), ("a", "index", "failed", 9), ("a", "verify", "succeeded", 9), ("a", "index", "succeeded", None)]
    assert changed(spark, tmp_path, rows, runs) == [("a", 5), ("a", 10), ("b", 0)]
    assert changed(spark, tmp_path, [], runs) == []
    assert changed(spark, tmp_path, rows[:1], []) == [("a", 0)]


def test_newest_ties(spark):
    df = entries(spark, [(1, "a", 0, "x", 1, 1, None, 1), (1, "a", 0, "y", 1, 1, None, 1), (None, "a", 0, "z", 1, 1, None, 1), (2, None, None, "n", None, None, None, None)])
    got = {(r.table_name, r.location) for r in newest(df, KEY, ["recorded_at", "entry_id"], ["location"]).collect()}
    assert got == {("a", "y"), (None, "n")}


def test_ledger_survives_failure(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")

    def listing(rows):
        return spark.createDataFrame(rows, "k string, v bigint").withColumn("checksum", checksum(["v"]))

    assert ledger.run("b1", listing([("a", 1), ("b", 2), ("b", 2), (None, None)]), ["k"]) == 3
    with pytest.raises(RuntimeError):
        ledger.run("b2", listing([("a", 1), ("b", 3), ("c", 4)]), ["k"], fail="write")
    assert ledger.committed() == ["b1"]
    assert ledger.run("b2", listing([("a", 1), ("b", 3), ("c", 4)]), ["k"]) == 2
    assert ledger.run("b2", listing([("a", 9)]), ["k"]) == 0
    assert ledger.run("b3", listing([("a", 1), ("b", 2), ("c", 4), (None, None)]), ["k"]) == 1
    assert ledger.run("b4", listing([]), ["k"]) == 0
    # ten comes after nine, whatever the text says; a stop after the commit repeats nothing
    for n in range(9, 12):
        assert ledger.run(str(n), listing([("d", n)]), ["k"]) == 1
    assert ledger.run("12", listing([("d", 11)]), ["k"]) == 0
    with pytest.raises(RuntimeError):
        ledger.run("13", listing([("d", 9)]), ["k"], fail="commit")
    assert ledger.run("13", listing([("d", 9)]), ["k"]) == 0 and ledger.committed()[-1] == "13"
    twice = listing([("e", 1), ("e", 2), ("e", 3)]).withColumn("at", F.expr("CASE v WHEN 2 THEN 9 ELSE v END"))
    assert [r.v for r in ledger.pending(twice, ["k"], order=["at"]).collect()] == [2]
    got = sorted((r.batch, str(r.k), r.v) for r in ledger.manifest("k string, v bigint, batch string").collect() if r.k != "d")
    assert got == [("b1", "None", None), ("b1", "a", 1), ("b1", "b", 2), ("b2", "b", 3), ("b2", "c", 4), ("b3", "b", 2)]


def test_file_listing(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12")
    (tmp_path / "b.bin").write_bytes(b"")
    got = {r.location.rsplit("/", 1)[1]: r.byte_count for r in file_listing(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": 2}


# ---- small files


def test_plan(spark):
    rows = [(i, "a", 5 * i, "x", 600_000, None, False, 1) for i in range(300)]
    rows += [(900, "a", 0, "new", None, 10, None, 2), (901, "b", 0, "x", 1_000_000, 1, False, 1), (902, "b", 5, "x", None, None, False, 1), (903, "b", 10, "x", 1, 1, True, 1), (904, None, None, "x", 1, 1, False, None)]
    df = entries(spark, rows)
    for stretch in (7, 100, 50_000):
        plan = plan_merges(df, target=4_000_000, open_cost=400_000, stretch=stretch).collect()
        assert sorted(r.entry_id for r in plan) == sorted([*range(1, 300), 900, 904])
        at_ = 0
        for r in sorted((r for r in plan if r.table_name == "a"), key=lambda r: r.lower_bound):
            assert r.bin == at_ // 4_000_000
            at_ += r.size + 400_000
    assert plan_merges(entries(spark, [])).count() == 0


def test_compact(spark, tmp_path):
    src = f"{tmp_path}/src"
    df = spark.range(0, 1000).select("id", F.when(F.col("id") % 3 == 0, "x").alias("s"), F.create_map(F.lit("k"), "id").alias("m"), F.lit(None).cast("binary").alias("b"))
    df.repartition(40).write.parquet(src)
    got, did = compact_folder(spark, src, out=f"file://{tmp_path}/out")
    assert (did.files_before, did.files_after, did.rows, did.checksum) == (40, 1, *fingerprint(df, df.columns)) and did.bytes_after < did.bytes_before
    with pytest.raises(FileExistsError):
        compact_folder(spark, src, out=f"file://{tmp_path}/out")
    assert sorted(r.id for r in got.collect()) == list(range(1000))
    assert len(got.inputFiles()) == 1 and len(spark.read.parquet(src).inputFiles()) == 40
    assert fingerprint(got, got.columns) == fingerprint(df, df.columns)
    many, did = compact_folder(spark, src, target_bytes=20_000, open_cost=1_000)
    assert did.files_after == len(many.inputFiles())
    assert 1 < len(many.inputFiles()) < 40 and many.count() == 1000
    spark.range(0).write.parquet(f"{tmp_path}/none")
    assert compact_folder(spark, f"{tmp_path}/none")[0].count() == 0


# ---- hot keys


def brute(rows, gap):
    by, out = {}, set()
    for key, pos, sub, id_, mark in set(rows):
        if None not in (key, pos, id_):
            by.setdefault(key, []).append(((pos, -1 if sub is None else sub, id_), mark))
    for group in by.values():
        group.sort(key=lambda x: x[0])
        for (a, ma), (b, mb) in zip(group, group[1:], strict=False):
            if ma is not None and ma == mb and b[0] - a[0] <= gap:
                out.add(b[2])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_segment_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot"] * 5 + ["k1", "k2", None]), rnd.randrange(200), rnd.choice([None, 0, 1, 2]), f"i{n}", rnd.choice(["m", "n", None])) for n in range(400)]
    rows += rows[:50] + [("hot", None, 1, "z", "m"), ("hot", 5, 1, None, "m")]
    df = spark.createDataFrame(rows, "key string, pos bigint, sub bigint, id string, mark string").withColumn("seg", F.lit("clash"))
    for gap, segment in ((3, 4), (3, 16), (0, 7), (3, 256)):
        got = [r.id for r in segment_pairs(df, gap, segment).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, gap)


def test_segment_pairs_edges(spark):
    empty = spark.createDataFrame([], "key string, pos bigint, sub bigint, id string, mark string")
    assert segment_pairs(empty).count() == 0
    with pytest.raises(ValueError):
        segment_pairs(empty, 5, 5)


def test_eager_join(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, 5), ("c", 7)], "k string, x bigint")
    right = spark.createDataFrame([("a", 10), ("a", None), ("a", 5), ("b", None), (None, 1), ("d", 1)], "k string, y bigint")
    got = {r.k: tuple(None if v is None else int(v) for v in r[1:]) for r in eager_join(left, right, "k", {"sx": F.col("x")}, {"sy": F.col("y")}).collect()}
    assert got == {"a": (2, 3, 6, 9, 30), "b": (1, 1, 1, 0, 0), "c": (1, 0, 0, 0, 0)}
    rolled = rollup_pairs(eager_join(left, right, "k", {"sx": F.col("x")}, {"sy": F.col("y")}), F.lit(1), ["sx", "sy"]).first()
    assert (rolled.n_keys, int(rolled.n_pairs)) == (3, 7)
    assert eager_join(left.limit(0), right, "k", {}, {}).count() == 0


# ---- drift


def test_types():
    assert [json_type(v) for v in ("s", 1, 1.0, True, [], {}, None)] == ["string", "bigint", "double", "boolean", "array", "object", None]
    assert read_record('{"a": 1, "a": "x"}') == {"a": "x"} and read_record("[1]") is None and read_record("bad") is None and read_record("") is None and read_record(None) is None
    assert to_text(255, "bigint") == ("0xff", True) and to_text(-1, "bigint") == ("-1", False) and to_text({"hex": "0x1"}, "object") == ("0x1", True) and to_text(1.5, "double") == ("1.5", False)


def drift(spark, files, payloads):
    f = spark.createDataFrame([(i, feed, seq, at(i), d, "clash") for i, feed, seq, d in files], "file_id bigint, feed string, file_seq bigint, written_at timestamp_ntz, declared_schema string, version string")
    r = spark.createDataFrame([(n, i, n, p, "clash") for n, (i, p) in enumerate(payloads)], "record_id bigint, file_id bigint, line_no bigint, payload string, version string")
    n = spark.createDataFrame([("type", "type"), ("type", "txType"), ("gas", "gas"), ("type", "txType")], "field string, known_name string")
    return f, r, n, profiles(r, n)


def test_drift(spark):
    big = '{"type": "0x1", "long": "' + "x" * 300_000 + '"}'
    f, r, n, p = drift(
        spark,
        [(1, "a", 1, '{"fields":[{"name":"type","type":"string"}]}'), (3, "a", 2, '{"fields":[{"name":"type","type":"string"}]}'), (2, "a", 3, None), (4, None, 1, "broken"), (5, "a", 4, None)],
        [(1, '{"type": "0x1", "gas": null}'), (3, '{"txType": 1, "gas": "0x5"}'), (3, '{"txType": "0x2"}'), (2, '{"type": 2.5, "gas": 7}'), (2, None), (2, "bad"), (9, '{"type": 1}'), (4, big)],
    )
    got = {tuple(x) for x in schema_changes(f, p, n).select("file_id", "field", "change_kind").collect()}
    assert got == {
        (3, "gas", "added"), (3, "type", "renamed"), (3, "type", "type_changed"), (3, "gas", "declared_differs"), (3, "type", "declared_differs"),
        (2, "type", "renamed"), (2, "type", "type_changed"), (2, "gas", "type_changed"), (5, "type", "removed"), (5, "gas", "removed"),
    }
    vers = versions(f, p)
    assert {x.file_id: (x.version, x.prev_id) for x in vers.collect()} == {1: (1, None), 3: (2, 1), 2: (3, 3), 5: (4, 2), 4: (1, None)}
    rows = {x.record_id: x for x in unify(r, vers, ["type", "gas"]).collect()}
    assert len(rows) == 8 and rows[1].type == "0x1" and rows[1].gas == "0x5" and rows[1].version == 2 and rows[2].type == "0x2"
    assert rows[3].issues == ["cast:type"] and rows[3].gas == "0x7" and rows[4].issues == rows[5].issues == ["unreadable"]
    assert rows[6].version is None and rows[6].type == "0x1" and len(rows[7].rest["long"]) == 300_000


def test_drift_clash_and_empty(spark):
    f, r, n, p = drift(spark, [(1, "a", 1, None)], [(1, '{"txType": "0x9", "type": "0x1"}'), (1, '{"type": "0x1", "txType": "0x1"}')])
    rows = sorted(unify(r, versions(f, p), ["type"]).collect(), key=lambda x: x.record_id)
    assert [x.type for x in rows] == ["0x1", "0x1"] and [x.issues for x in rows] == [["clash:type"], []]
    f, r, n, p = drift(spark, [], [])
    assert schema_changes(f, p, n).count() == versions(f, p).count() == unify(r, versions(f, p), ["type"]).count() == 0


def shapes(*versions_):
    return [[{"field": f, "name": n, "type": t} for f, n, t in v] for v in versions_]


def test_migrations():
    a, b, c = shapes(
        [("gas", "gas", "bigint"), ("type", "txType", "string"), ("old", "old", "double")],
        [("gas", "gasLimit", "string"), ("type", "type", "string"), ("fee", "fee", "string")],
        [("gas", "gas", "bigint"), ("type", "kind", "bigint"), ("fee", "fee", "string")],
    )
    assert migration(a, b) == [["rename", "gas", "gasLimit"], ["rename", "txType", "type"], ["default", "fee", None], ["cast", "gasLimit", "bigint", "string"]]
    assert migration(b, b) == [] and migration([], []) == []
    whole = migration(a, b) + migration(b, c) + canonical(c, ["gas", "type", "fee", "to"], {"to": "0x"}) + canonical(a, ["gas", "type", "fee", "to"], {"to": "0x"})
    assert collapse(a, whole) == [["rename", "txType", "type"], ["default", "fee", None], ["default", "to", "0x"], ["cast", "gas", "bigint", "string"], ["cast", "old", "double", "string"]]


@given(st.lists(st.lists(st.tuples(st.sampled_from("fgh"), st.sampled_from(["", "_x", "_y"]), st.sampled_from(["string", "bigint", "double"])), max_size=5), min_size=1, max_size=5))
def test_chained_steps_end_where_direct_ones_do(versions_):
    all_ = shapes(*[sorted({(f, f + n, t) for f, n, t in v}) for v in versions_])
    steps = canonical(all_[-1])
    for now, after in zip(all_[-2::-1], all_[:0:-1], strict=True):
        steps = collapse(now, migration(now, after) + collapse(after, steps) + canonical(now))
    assert {tuple(s) for s in steps if s[0] == "rename"} == {tuple(s) for s in canonical(all_[0]) if s[0] == "rename"}
    # every value ends as text: each name's types are cast, under its last name, all the way
    assert {tuple(s) for s in steps if s[0] == "cast"} == {("cast", x["field"], x["type"], "string") for x in all_[0] if x["type"] != "string"}


def test_unify_carries_out_the_steps(spark):
    f, r, n, p = drift(spark, [(1, "a", 1, None), (2, "a", 2, None)], [(1, '{"txType": 5, "gas": "0x1"}'), (1, '{"gas": null}'), (2, '{"type": "0x7", "gas": 9}')])
    vers = versions(f, p, ["type", "gas", "to"], {"to": "0xdef"})
    steps = {x.file_id: (json.loads(x.migration), json.loads(x.steps)) for x in vers.collect()}
    assert steps[1][0] == [["rename", "txType", "type"], ["cast", "gas", "string", "bigint"], ["cast", "type", "bigint", "string"]] and steps[2][0] == []
    assert steps[1][1] == [["rename", "txType", "type"], ["default", "to", "0xdef"], ["cast", "type", "bigint", "string"]]

    def table(v):
        return [tuple(x)[4:7] + (x.issues,) for x in sorted(unify(r, v, ["type", "gas", "to"]).collect(), key=lambda x: x.record_id)]

    assert table(vers) == [("0x5", "0x1", "0xdef", []), (None, None, "0xdef", []), ("0x7", "0x9", "0xdef", [])]
    # without a step nothing is renamed, filled in or cast
    bare = vers.withColumn("steps", F.lit("[]"))
    assert table(bare) == [(None, "0x1", None, ["cast:txType"]), (None, None, None, []), ("0x7", "9", None, ["cast:gas"])]
    assert table(vers.withColumn("steps", F.lit('[["rename","txType","type"]]')))[0] == ("5", "0x1", None, ["cast:type"])
