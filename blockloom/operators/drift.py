"""Schemas that drift between files.

Each file's records give its profile: which names and JSON types its fields have.
A profile's fingerprint is its version; neighbouring versions give the list of
changes and the explicit steps (rename, default, cast) from one to the next. Chained to
the last version and on to the consistent table, they are what a file's records go through.

Records are parsed in Arrow batches in Python: the JVM's variant reader loses
whether a number was written with a fraction, and drops whole integers above 38
digits to double.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.session import written

PROFILE_LIMIT = 50_000
"""Distinct (file, name, type) counts a profiling task holds before it hands them on."""


def json_type(value) -> str | None:
    """string, bigint (written without fraction), double, boolean, array, object; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    return {str: "string", int: "bigint", float: "double", list: "array", dict: "object"}[type(value)]


def read_record(payload: str | None) -> dict | None:
    """The JSON object, the last of repeated names winning; None for anything else."""
    try:
        record = json.loads(payload) if payload else None
    except ValueError:
        return None
    return record if isinstance(record, dict) else None


def _profile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file_id", pa.int64()), ("name", pa.string()), ("type", pa.string()), ("n", pa.int64())])
    counts: dict[tuple, int] = {}

    def flush() -> pa.RecordBatch:
        cols = list(zip(*[(*k, n) for k, n in counts.items()], strict=True)) or [[], [], [], []]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    for batch in batches:
        for file_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for name, value in (read_record(payload) or {}).items():
                kind = json_type(value)
                if kind:
                    key = (file_id, name, kind)
                    counts[key] = counts.get(key, 0) + 1
            if len(counts) > PROFILE_LIMIT:
                yield flush()
    yield flush()


def profiles(records: DataFrame, names: DataFrame) -> DataFrame:
    """file_id, field, name, type, n: what the non-null values of each file look like.

    records: file_id, payload. names: field, known_name; a name not listed stands
    for itself. Counts are combined inside the reading tasks, so a file holding a
    third of all records does not make a long task. Unreadable payloads, records
    that are no objects, and null values count for nothing.
    """
    found = records.select(F.col("file_id").cast("bigint"), F.col("payload").cast("string")).filter("file_id is not null").mapInArrow(_profile_batches, "file_id bigint, name string, type string, n bigint")
    known = known_fields(names)
    return (
        found.groupBy("file_id", "name", "type").agg(F.sum("n").alias("n"))
        .join(known, "name", "left")
        .select("file_id", F.coalesce("field", "name").alias("field"), "name", "type", "n")
    )


def known_fields(names: DataFrame) -> DataFrame:
    """name, field: which field a known name stands for; of several the least."""
    return names.groupBy(F.col("known_name").alias("name")).agg(F.min("field").alias("field"))


#: A file's schema: its sorted (field, name, type) triples.
SHAPE = "array<struct<field:string,name:string,type:string>>"


def fingerprint(shape: Column) -> Column:
    """SHA-256 of a schema's triples, as JSON; one without fields has a fingerprint too."""
    rows = F.transform(shape, lambda x: F.array(x["field"], x["name"], x["type"]))
    return F.sha2(F.coalesce(F.to_json(rows), F.lit("[]")), 256)


def by_field(shape: Sequence[dict]) -> dict[str, dict[str, set[str]]]:
    """field -> name -> types of a schema."""
    out: dict[str, dict[str, set[str]]] = {}
    for x in shape:
        out.setdefault(x["field"], {}).setdefault(x["name"], set()).add(x["type"])
    return out


def migration(now: Sequence[dict], after: Sequence[dict]) -> list[list]:
    """Steps that bring records of one version to the next: ["rename", name, to], ["default", name, value], ["cast", name, type, to].

    Names that the next version lacks become its own name of the field (the field
    itself if it is one), fields it adds have null by default, and types it lacks are
    cast to its own (text if it is one). A field that it no longer has is carried on.
    """
    old, new = by_field(now), by_field(after)
    renames, defaults, casts = [], [], []
    for field in sorted(old):
        if field not in new:
            continue
        to = field if field in new[field] else min(new[field])
        renames += [["rename", n, to] for n in sorted(old[field]) if n not in new[field]]
        had, has = (set().union(*x[field].values()) for x in (old, new))
        kind = "string" if "string" in has else min(has)
        stay = sorted({n for n in old[field] if n in new[field]} | {to})
        casts += [["cast", n, t, kind] for n in stay for t in sorted(had - has)]
    for field in sorted(set(new) - set(old)):
        defaults.append(["default", field if field in new[field] else min(new[field]), None])
    return renames + defaults + casts


def canonical(shape: Sequence[dict], fields: Sequence[str] = (), defaults: dict[str, str] | None = None) -> list[list]:
    """Steps that bring records of a version to the consistent table: own field names, `defaults` (null) for the `fields` it lacks, text."""
    have = by_field(shape)
    renames = [["rename", n, f] for f in sorted(have) for n in sorted(have[f]) if n != f]
    missing = [["default", f, (defaults or {}).get(f)] for f in fields if f not in have]
    return renames + missing + [["cast", f, t, "string"] for f in sorted(have) for t in sorted(set().union(*have[f].values()) - {"string"})]


def collapse(shape: Sequence[dict], steps: Sequence[list]) -> list[list]:
    """Steps of a version that do at once what `steps` do one after the other: each name's last name, and each type's last type.

    A cast between versions must lose nothing, so the last one alone gives the same
    value. Of several defaults of a name the last counts that is not null.
    """
    renames, defaults, casts = {}, {}, {}
    ends: dict[str, str] = {}
    for s in steps:
        if s[0] == "default":
            defaults[s[1]] = s[2] if s[2] is not None else defaults.get(s[1])
    for x in shape:
        name, kind = x["name"], x["type"]
        for s in steps:
            if s[0] == "rename" and s[1] == name:
                name = s[2]
            elif s[0] == "cast" and s[1] == name and s[2] == kind:
                kind = s[3]
        ends[x["name"]] = name
        if x["name"] != name:
            renames[x["name"]] = name
        if kind != x["type"]:
            casts[name, x["type"]] = kind
    had = set(ends.values())
    for s in steps:  # a default of a name that is renamed later is one of its last name
        if s[0] == "rename" and s[1] in defaults and s[1] not in had:
            defaults.setdefault(s[2], defaults.pop(s[1]))
    return [["rename", *x] for x in sorted(renames.items())] + [["default", *x] for x in sorted(defaults.items()) if x[0] not in had] + [["cast", *k, v] for k, v in sorted(casts.items())]


def versions(files: DataFrame, profile: DataFrame, fields: Sequence[str] = (), defaults: dict[str, str] | None = None) -> DataFrame:
    """file_id, feed, file_seq, prev_id, shape, prev_shape, fingerprint, prev_fingerprint, version, migration, steps.

    fingerprint: of the sorted (field, name, type) triples; null and other orders of
    records do not change it. version counts the changes of fingerprint along the
    feed, from 1. migration: the explicit steps to the feed's next version, as a JSON
    list. steps: all migrations from here to the feed's last version and on to the
    consistent table, chained and collapsed. fields: those the consistent table has;
    one that a version lacks gets a default step. Repeated rows of a file count once
    (the last by written_at); a null feed is a feed. A feed's files are chained in one
    task, which holds the steps of one file at a time.
    """
    per_file = profile.groupBy("file_id").agg(F.sort_array(F.collect_set(F.struct("field", "name", "type"))).alias("shape"))
    one = files.groupBy("file_id").agg(F.max(F.struct("written_at", "feed", "file_seq")).alias("f")).select("file_id", "f.feed", "f.file_seq")
    shaped = one.join(per_file, "file_id", "left").select("file_id", "feed", "file_seq", F.coalesce("shape", F.array().cast(SHAPE)).alias("shape"))
    feed = W.partitionBy("feed").orderBy("file_seq", "file_id")
    marked = (
        shaped.withColumn("fingerprint", fingerprint(F.col("shape")))
        .withColumn("prev_id", F.lag("file_id").over(feed)).withColumn("prev_shape", F.lag("shape").over(feed)).withColumn("prev_fingerprint", F.lag("fingerprint").over(feed))
        .withColumn("version", F.sum(F.coalesce((F.col("prev_fingerprint") != F.col("fingerprint")).cast("bigint"), F.lit(1))).over(feed))
    )
    fields, own_defaults = list(fields), dict(defaults or {})

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From each feed's last file back: a version's steps are its migration, then those of the next version."""
        last: tuple | None = None
        for batch in batches:
            to_next, whole = [], []
            rows = zip(*[batch.column(i).to_pylist() for i in (batch.schema.get_field_index("feed"), batch.schema.get_field_index("fingerprint"), batch.schema.get_field_index("shape"))], strict=True)
            for own, mark, shape in rows:
                if last is None or last[0] != own:
                    steps, after = canonical(shape, fields, own_defaults), []
                elif last[1] == mark:
                    steps, after = last[3], last[4]
                else:
                    after = migration(shape, last[2])
                    steps = after + last[3] + canonical(shape, fields, own_defaults)
                if last is None or last[:2] != (own, mark):
                    steps = collapse(shape, steps)
                last = (own, mark, shape, steps, after)
                to_next.append(json.dumps(after, separators=(",", ":")))
                whole.append(json.dumps(steps, separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to_next, pa.string()), pa.array(whole, pa.string())], names=[*batch.schema.names, "migration", "steps"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema.fields)
    return marked.repartition("feed").sortWithinPartitions("feed", F.desc("file_seq"), F.desc("file_id")).mapInArrow(chain, f"{kinds}, migration string, steps string")


def _differences(both: DataFrame) -> DataFrame:
    """file_id, field, and its names, types and pairs in the shapes `a` and `b`, for each field of either."""
    each = both.select("*", F.explode(F.array_distinct(F.concat(*[F.transform(c, lambda x: x["field"]) for c in ("a", "b")]))).alias("field"))

    def part(shape: str, what) -> Column:
        return F.array_sort(F.array_distinct(F.transform(F.filter(shape, lambda x: x["field"] == F.col("field")), what)))

    cols = [part(c, what).alias(f"{c}_{n}") for c in ("a", "b") for n, what in (("names", lambda x: x["name"]), ("types", lambda x: x["type"]), ("pairs", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"))))]
    return each.select("file_id", "field", *cols)


def schema_changes(files: DataFrame, profile: DataFrame, names: DataFrame) -> DataFrame:
    """file_id, field, change_kind, before, after: every change of every file.

    A file whose fingerprint is that of the file before it (by file_seq, then file_id) has
    none. Between two versions, per field: added, removed, renamed (other set of
    names), type_changed (other set of types). And, for a file with a readable
    declared_schema whose fingerprint is another than that of its records, per field
    declared_differs if the declared (name, type) pairs are not those found. A file
    without readable records has no fields. before and after show the pairs as JSON.
    """
    vers = written(versions(files, profile), "versions")
    moved = vers.filter("prev_id is not null and fingerprint <> prev_fingerprint").select("file_id", F.col("prev_shape").alias("a"), F.col("shape").alias("b"))
    none = F.size("a_names") == 0, F.size("b_names") == 0
    kinds = F.array(
        F.when(none[0], "added"), F.when(none[1], "removed"), F.when(~none[0] & ~none[1] & (F.col("a_names") != F.col("b_names")), "renamed"), F.when(~none[0] & ~none[1] & (F.col("a_types") != F.col("b_types")), "type_changed")
    )

    def shown(c: str) -> Column:
        return F.when(F.size(c) > 0, F.to_json(c))

    drift = _differences(moved).select("file_id", "field", F.explode(F.array_compact(kinds)).alias("change_kind"), shown("a_pairs").alias("before"), shown("b_pairs").alias("after"))

    # repeated rows of a file agree or count as one set
    told = files.select("file_id", F.from_json("declared_schema", "struct<fields:array<struct<name:string,type:string>>>").alias("d")).filter("d.fields is not null").select("file_id", "d.fields")
    known = known_fields(names).withColumnRenamed("field", "known_field")
    triple = F.struct(F.coalesce("known_field", "name").alias("field"), "name", F.coalesce("type", F.lit("")).alias("type"))
    declared = told.select("file_id", F.explode_outer("fields").alias("x")).select("file_id", "x.*").join(known, "name", "left").groupBy("file_id").agg(F.sort_array(F.collect_set(F.when(F.col("name").isNotNull(), triple))).alias("a"))
    differs = _differences(declared.join(vers.select("file_id", F.col("shape").alias("b")), "file_id").filter(fingerprint(F.col("a")) != fingerprint(F.col("b")))).filter("a_pairs <> b_pairs")
    return drift.unionByName(differs.select("file_id", "field", F.lit("declared_differs").alias("change_kind"), shown("a_pairs").alias("before"), shown("b_pairs").alias("after")))


def to_text(value, kind: str) -> tuple[str | None, bool]:
    """The cast rule of one value to canonical text, and whether it fits.

    Integers become hex; an object with a `hex` text gives that text. Numbers with
    a fraction, booleans, arrays and other objects have no hex form: they are kept
    as JSON text and reported.
    """
    if kind == "string":
        return value, True
    if kind == "bigint":
        return (hex(value), True) if value >= 0 else (str(value), False)
    if kind == "object" and isinstance(value.get("hex"), str):
        return value["hex"], True
    return json.dumps(value, separators=(",", ":")), False


def unify(records: DataFrame, vers: DataFrame, fields: Sequence[str]) -> DataFrame:
    """All records as one table: record_id, file_id, line_no, version, the `fields`
    as text, rest (fields not listed, as a map) and issues.

    Each record is routed through its file's steps: renames, then defaults for absent
    fields, then casts of the types that the steps name. Other fields are null. issues
    lists what the steps could not settle: `unreadable`, `cast:<field>` (kept as JSON
    text: no step casts the type, or the value does not fit) and `clash:<field>` (two
    names of a field in one record with different values; the field's own name wins,
    else the first). A field that is null in a record, but not absent from its file, is
    null. Records of files that are not listed have no steps and a null version: their
    names stand for themselves and every type is cast. No record is dropped or repeated.
    """
    fields = list(fields)
    out = ", ".join(["record_id bigint", "file_id bigint", "line_no bigint", "version bigint", *[f"`{f}` string" for f in fields], "rest map<string,string>", "issues array<string>"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[str | None, tuple] = {}
        kept = set(fields)
        for batch in batches:
            rows: dict[str, list] = {f: [] for f in fields}
            rest, issues = [], []
            for payload, steps in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if steps not in plans:
                    if len(plans) > 1000:
                        plans.clear()
                    todo = json.loads(steps or "[]")
                    plans[steps] = ({s[1]: s[2] for s in todo if s[0] == "rename"}, {s[1]: s[2] for s in todo if s[0] == "default" and s[2] is not None}, {(s[1], s[2]) for s in todo if s[0] == "cast" and s[3] == "string"})
                renames, missing, casts = plans[steps]
                record = read_record(payload)
                bad = [] if record is not None else ["unreadable"]
                values: dict[str, str | None] = {}
                own = set()
                for name, value in (record or {}).items():
                    field = renames.get(name, name)
                    kind = json_type(value)
                    if kind is None:
                        continue
                    if kind == "string" or steps is None or (field, kind) in casts:
                        text, fits = to_text(value, kind)
                    else:
                        text, fits = json.dumps(value, separators=(",", ":")), False
                    if field in values and values[field] != text:
                        bad.append(f"clash:{field}")
                    if field not in values or (name == field and field not in own):
                        values[field] = text
                    if name == field:
                        own.add(field)
                    if not fits:
                        bad.append(f"cast:{field}")
                if record is not None:
                    for f, value in missing.items():
                        values.setdefault(f, value)
                for f in fields:
                    rows[f].append(values.get(f))
                rest.append([(k, v) for k, v in values.items() if k not in kept])
                issues.append(bad)
            cols = [batch.column(i) for i in range(4)] + [pa.array(rows[f], pa.string()) for f in fields] + [pa.array(rest, pa.map_(pa.string(), pa.string())), pa.array(issues, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["record_id", "file_id", "line_no", "version", *fields, "rest", "issues"])

    # a version's steps repeat for each of its records only inside a batch, as one shared text
    joined = records.select("record_id", "file_id", "line_no", "payload").join(vers.select("file_id", "version", "steps"), "file_id", "left")
    return joined.select("record_id", "file_id", "line_no", F.col("version").cast("bigint"), "payload", "steps").mapInArrow(route, out)
