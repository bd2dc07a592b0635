"""Distinct counts over identifier sets too large to hold, as coded runs of hashes.

A set is stored as sorted runs of 64-bit hashes, coded as differences in variable
length bytes. A run covers one bucket of the hash range and carries the bucket's width,
so a large set is many bounded runs and the counts of its buckets add up. Runs of
several sets, of whatever widths, are merged by union, bucket by bucket; the merged
runs are runs again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a reading task gathers before it drops repeated ones, and hashes that wait for a union.
CHUNK = 1 << 19
#: Hashes of a run, about; larger sets are cut into buckets.
PER_RUN = 1 << 17


def encode(hashes: np.ndarray, base: int = 0) -> bytes:
    """Sorted distinct uint64 hashes, none below `base`, as coded differences."""
    return _code(np.diff(hashes, prepend=np.uint64(base)))[0].tobytes()


def _code(deltas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first; the high bit says that more follow. Also the length of each code."""
    size = np.ones(len(deltas), np.int64)
    rest = deltas >> np.uint64(7)
    while rest.any():
        size += rest > 0
        rest >>= np.uint64(7)
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    rest = deltas.copy()
    live = np.arange(len(deltas))
    step = 0
    while len(live):
        more = size[live] > step + 1
        out[starts[live] + step] = (rest[live] & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        rest[live] >>= np.uint64(7)
        live = live[more]
        step += 1
    return out, size


def decode(run: bytes, base: int = 0) -> np.ndarray:
    """The hashes of a coded run."""
    raw = np.frombuffer(run, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    deltas = np.zeros(len(ends), np.uint64)
    size = ends - starts
    for step in range(int(size.max()) + 1 if len(ends) else 0):
        at = size >= step
        deltas[at] |= (raw[starts[at] + step] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * step)
    return np.cumsum(deltas, dtype=np.uint64) + np.uint64(base)


def union(runs: Sequence[np.ndarray]) -> np.ndarray:
    """K-way union of sorted runs; the stable sort merges runs that are sorted already."""
    if len(runs) == 1:
        return runs[0]
    merged = np.sort(np.concatenate(runs), kind="stable")
    return merged[np.concatenate([[True], merged[1:] != merged[:-1]])] if len(merged) else merged


def bucket_bits(rows: int, per_run: int = PER_RUN) -> int:
    """Hash bits that name the bucket, so that a set of `rows` has runs of about `per_run` hashes."""
    return min(24, max(0, math.ceil(math.log2(max(rows, 1) / per_run))))


def _bits_of(n: Column, per_run: int) -> Column:
    """`bucket_bits` of a column of sizes."""
    return F.least(F.lit(24), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) / F.lit(per_run))))).cast("int")


def _with_bits(rows: DataFrame, sizes: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """`rows` with the bits of their keys; keys that `sizes` lacks or gives none have 0.

    Only keys of more than one bucket are sent to the tasks. Each has over PER_RUN
    rows, so there are at most rows / PER_RUN of them: 80 000 of 10^10 rows.
    """
    wide = sizes.filter(F.col(name) > 0).select(*[F.col(f"`{k}`").alias(f"_{k}") for k in keys], F.col(name).alias("_wide"))
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_{k}`")) for k in keys]
    return rows.join(F.broadcast(wide), on, "left").withColumn(name, F.coalesce("_wide", F.lit(0))).drop("_wide", *[f"_{k}" for k in keys])


def _base(bits: int, bucket: int) -> int:
    """The least hash of a bucket."""
    return bucket << (64 - bits) if bits else 0


def build_runs(df: DataFrame, groups: Sequence[str], ids: dict[str, Column], bits: int | None = None, hashed: bool = False, sizes: DataFrame | None = None, per_run: int = PER_RUN) -> DataFrame:
    """Coded runs per group, side and bucket: `groups..., side string, bits int, bucket int, n bigint, run binary`.

    groups: string columns; null is a group of its own. ids: what is counted, by the
    name of its side; nulls count for nothing. hashed: ids are 64-bit hashes already.
    An empty text is an identifier like any other, repeated rows count once, and
    other columns are not read. An empty table has no runs.

    A run carries the number of hash bits that name its bucket. They follow from the
    size of its own group, so a run holds about `per_run` hashes, or its whole set if
    that is smaller, however large the table is. sizes: rows (`n`) of each group where
    they are known, else they are counted; they set the width only. bits: one width for
    all groups instead. Reading tasks drop what repeats in a chunk, so a value holding a
    third of all rows is shuffled once a chunk; the hashes are shuffled once, by group
    and bucket, and coded where they arrive. Each bucket has one run.
    """
    groups, sides = list(groups), list(ids)
    hashes = {n: (c if hashed else F.when(c.isNotNull(), F.xxhash64(c))) for n, c in ids.items()}
    picked = df.select(*[F.col(f"`{g}`").cast("string").alias(g) for g in groups], *[c.alias(n) for n, c in hashes.items()])

    def distinct(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(tables).combine_chunks()
        keys, labels = np.zeros(len(table), np.int64), []
        for g in groups:
            coded = table[g].combine_chunks().dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            index = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            labels.append(pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([None], pa.string())]))
            keys = keys * len(labels[-1]) + index
        for side in sides:
            col = table[side].combine_chunks()
            there = col.is_valid().to_numpy(zero_copy_only=False)
            found, own = col.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), keys[there]
            order = np.lexsort((found, own))
            found, own = found[order], own[order]
            keep = np.ones(len(found), bool)
            keep[1:] = (found[1:] != found[:-1]) | (own[1:] != own[:-1])
            found, rest, parts = found[keep], own[keep], []
            for values in reversed(labels):
                parts.insert(0, values.take(pa.array(rest % len(values))))
                rest = rest // len(values)
            out = pa.Table.from_arrays([*parts, pa.array([side], pa.string()).take(pa.array(np.zeros(len(found), np.int64))), pa.array(found)], names=[*groups, "side", "_hash"])
            yield from out.to_batches(1 << 16)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += len(batch)
            if rows >= CHUNK:
                yield from distinct(held)
                held, rows = [], 0
        if rows:
            yield from distinct(held)

    texts = ", ".join([*[f"`{g}` string" for g in groups], "side string"])
    once = picked.mapInArrow(combine, f"{texts}, _hash bigint")
    if bits is not None:
        once = once.withColumn("bits", F.lit(bits))
    else:
        counted = sizes if sizes is not None else picked.groupBy(*[f"`{g}`" for g in groups]).agg(F.count(F.lit(1)).alias("n"))
        once = _with_bits(once, counted.withColumn("bits", _bits_of(F.col("n"), per_run)), groups, "bits")
    placed = once.withColumn("bucket", F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(_hash, 64 - bits)")).otherwise(F.lit(0)).cast("int"))
    keys = [*groups, "side", "bits", "bucket"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Runs(keys)
        now, parts = None, []

        def close() -> None:
            if now is not None:
                out.add(now, np.unique(np.concatenate(parts)))

        for batch in batches:
            hashes_ = batch.column(len(keys)).to_numpy(zero_copy_only=False).view(np.uint64)
            change = np.zeros(len(batch), bool)
            change[:1] = True
            for i in range(len(keys)):
                index = batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= index[1:] != index[:-1]
            starts = np.flatnonzero(change)
            for at, end in zip(starts, np.append(starts[1:], len(batch)), strict=True):
                key = tuple(batch.column(i)[int(at)].as_py() for i in range(len(keys)))
                if key != now:
                    close()
                    now, parts = key, []
                    yield from out.full()
                parts.append(hashes_[at:end])
        close()
        yield from out.rest()

    return placed.select(*keys, "_hash").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(code, f"{texts}, bits int, bucket int, n bigint, run binary")


class _Runs:
    """Runs on their way out of a task, in record batches of bounded size."""

    def __init__(self, keys: Sequence[str]):
        self.names, self.rows, self.size = [*keys, "n", "run"], [], 0
        self.types = [pa.string()] * (len(keys) - 2) + [pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def add(self, key: tuple, hashes: np.ndarray) -> None:
        run = encode(hashes, _base(*key[-2:]))
        self.rows.append((*key, len(hashes), run))
        self.size += len(run)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            cols = list(zip(*self.rows, strict=True))
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, self.types, strict=True)], names=self.names)

    def full(self) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= 1000 or self.size > 1 << 23:
            yield from self.rest()


def merge_runs(runs: DataFrame, keys: Sequence[str], bits: int | None = None, per_run: int = PER_RUN) -> DataFrame:
    """Union of all runs with the same keys and side; one run a bucket, in the form of `build_runs`.

    Runs may be of any widths. Those of a set are brought to one width, the greatest
    among them or, if more, what their sizes together ask for (bits: at least that many);
    a coarser run is split at the bucket bounds. Each task streams the runs of a bucket
    in turn and holds their union so far plus at most as much again, however many runs
    there are. The runs are read twice; they should be a written table.
    """
    keys = [*keys, "side"]
    sizes = runs.groupBy(*keys).agg(F.greatest(F.max("bits"), _bits_of(F.sum("n"), per_run), F.lit(bits or 0)).alias("wide"))
    marked = _with_bits(runs.select(*keys, "bits", "bucket", "n", "run"), sizes, keys, "wide")
    names = [*keys, "bits", "bucket", "n", "run"]
    schema = ", ".join([*[f"`{k}` string" for k in keys], "bits int", "bucket int", "n bigint", "run binary"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, wide = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("bits", "wide"))
            coarse = own < wide
            rest = batch.filter(pa.array(~coarse))
            if len(rest):
                # rebuilt, as all batches of a task must agree in which columns may be null
                yield pa.RecordBatch.from_arrays([rest.column(rest.schema.get_field_index(c)) for c in names], names=names)
            out = _Runs(names[:-2])
            for row in batch.filter(pa.array(coarse)).to_pylist():
                hashes = decode(row["run"], _base(row["bits"], row["bucket"]))
                bucket = (hashes >> np.uint64(64 - row["wide"])).astype(np.int64)
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                for a, b in zip(first, np.append(first[1:], len(hashes)), strict=True):
                    out.add((*[row[k] for k in keys], row["wide"], int(bucket[a])), hashes[a:b])
                    yield from out.full()
            yield from out.rest()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Runs(names[:-2])
        now: tuple | None = None
        whole, waiting, size = np.zeros(0, np.uint64), [], 0

        def settle() -> None:
            nonlocal whole, waiting, size
            if waiting:
                whole = union([whole, *waiting] if len(whole) else waiting)
                waiting, size = [], 0

        for batch in batches:
            for *key, _, run in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key = tuple(key)
                if key != now:
                    if now is not None:
                        settle()
                        out.add(now, whole)
                        yield from out.full()
                    now, whole = key, np.zeros(0, np.uint64)
                waiting.append(decode(run, _base(*key[-2:])))
                size += len(waiting[-1])
                if size > max(CHUNK, len(whole)):
                    settle()
        if now is not None:
            settle()
            out.add(now, whole)
        yield from out.rest()

    by = names[:-2]
    return marked.mapInArrow(split, schema).repartition(*by).sortWithinPartitions(*by).mapInArrow(task, schema)


def grouping_sets(runs: DataFrame, groups: Sequence[str], sets: Sequence[Sequence[str]], total: str = "all") -> DataFrame:
    """Each run once for every grouping set; a column left out of the set reads `total`."""
    rows = F.array(*[F.struct(*[(F.col(g) if g in s else F.lit(total)).alias(g) for g in groups]) for s in sets])
    return runs.select(F.explode(rows).alias("_g"), "side", "bits", "bucket", "n", "run").select("_g.*", "side", "bits", "bucket", "n", "run")


def counts(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, side, n_distinct, expected_collisions, relative_error from merged runs.

    Two identifiers with one hash count as one. With n of them, n * (n - 1) / 2^65
    such pairs are expected (the birthday bound); the count is low by no more than
    that on average, and relative_error is that share of it.
    """
    n = F.col("n_distinct").cast("double")
    return (
        merged.groupBy(*keys, "side").agg(F.sum("n").alias("n_distinct"))
        .withColumn("expected_collisions", n * (n - 1) / F.lit(2.0**65))
        .withColumn("relative_error", (n - 1) / F.lit(2.0**65))
    )
