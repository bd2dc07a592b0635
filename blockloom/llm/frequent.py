"""Most frequent values of a column in bounded memory.

Values are hash-partitioned, so each task sees all of its values' occurrences. It
feeds them to its own count-min sketch with conservative update and keeps the
heaviest candidates in a bounded heap. The heaps are disjoint; merging them is a
union.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.session import written

#: Distinct values a reading task combines before it hands on their counts.
COMBINE = 1 << 17
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class Sketch:
    """Count-min sketch with conservative update, taking batches of distinct values.

    An estimate is never below the true count; beyond width w and depth d it exceeds
    it by more than e * total / w with a probability of at most exp(-d).
    """

    def __init__(self, width_bits: int = 16, depth: int = 4):
        self.cells = np.zeros((depth, 1 << width_bits), np.int64)
        self.shift, self.depth = np.uint64(64 - width_bits), depth

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Add counts of values given by their (distinct) 64-bit hashes; returns the new estimates.

        Each value raises its cells to its old estimate plus its count, and no
        further. Values of one batch that share a cell leave the greater of the two
        in it, which is still no less than either's true count.
        """
        at = [((hashes ^ (hashes >> np.uint64(31))) * _ODD[d]) >> self.shift for d in range(self.depth)]
        new = np.min([self.cells[d][at[d]] for d in range(self.depth)], axis=0) + counts
        for d in range(self.depth):
            np.maximum.at(self.cells[d], at[d], new)
        return new


class Heap:
    """The `size` values of the greatest estimates, each with the count seen since it entered."""

    def __init__(self, size: int):
        self.size, self.held, self.floor = size, {}, 0

    def offer(self, keys: list, estimates: list[int], counts: list[int]) -> None:
        for key, estimate, count in zip(keys, estimates, counts, strict=True):
            old = self.held.get(key)
            if old is not None:
                self.held[key] = (estimate, old[1] + count)
            elif estimate > self.floor or len(self.held) < self.size:
                self.held[key] = (estimate, count)
                if len(self.held) > 2 * self.size:
                    self.trim()

    def trim(self) -> None:
        if len(self.held) > self.size:
            best = heapq.nlargest(self.size, self.held.items(), key=lambda x: (x[1][0], x[0]))
            self.held, self.floor = dict(best), best[-1][1][0]


def candidates(values: DataFrame, capacity: int = 1000, width_bits: int = 16, depth: int = 4) -> DataFrame:
    """Heavy candidates per side: `side, value, lower, upper, bound`.

    values: side string, value string (a null value is counted for its side, but is
    no candidate). The true count lies in [lower, upper]; lower is what was counted
    since the value entered its heap, upper the sketch's estimate. bound is what
    upper may exceed the truth by, but for a chance of exp(-depth). Per side, one
    further row with a null value has all occurrences of the side as lower and upper, and
    as bound the greatest estimate of any value that a full heap gave up (0 if none did).
    Memory of a task: the sketches and heaps of each side, whatever the input. A
    value holding a third of all rows is combined in the reading tasks first, so it
    reaches its partition as one row per task. Every row counts, repeated ones too; an
    empty text is a value. Of values with equal estimates at the end of a full heap
    the greater text stays. Empty input gives no rows; other columns are not read.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def squash() -> pa.Table:
            return pa.concat_tables(held).group_by(["side", "value", "h"]).aggregate([("n", "sum")]).rename_columns(["side", "value", "h", "n"]).combine_chunks()

        for batch in batches:
            held.append(pa.Table.from_batches([batch]).append_column("n", pa.array(np.ones(len(batch), np.int64))))
            rows += len(batch)
            if rows >= 2 * COMBINE:
                held = [squash()]
                rows = len(held[0])
                if rows >= COMBINE:
                    yield from held[0].to_batches(1 << 14)
                    held, rows = [], 0
        if rows:
            yield from squash().to_batches(1 << 14)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, list] = {}

        def feed(table: pa.Table) -> None:
            table = table.group_by(["side", "value", "h"]).aggregate([("n", "sum")])
            side = np.array(table["side"].to_pylist(), object)
            for s in dict.fromkeys(side.tolist()):
                mine = state.setdefault(s, [Sketch(width_bits, depth), Heap(capacity), 0])
                part = table.filter(pa.array(side == s))
                counts = part["n_sum"].to_numpy()
                mine[2] += int(counts.sum())
                part = part.filter(part["value"].is_valid())
                counts = part["n_sum"].to_numpy()
                if not len(counts):
                    continue
                estimates = mine[0].add(part["h"].to_numpy().astype(np.int64).view(np.uint64), counts)
                heap = mine[1]
                able = estimates >= heap.floor
                heap.offer(part["value"].filter(pa.array(able)).to_pylist(), estimates[able].tolist(), counts[able].tolist())

        held, rows = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += len(batch)
            if rows >= COMBINE:
                feed(pa.concat_tables(held))
                held, rows = [], 0
        if rows:
            feed(pa.concat_tables(held))
        out = []
        for side, (_, heap, total) in state.items():
            heap.trim()
            bound = math.ceil(math.e * total / (1 << width_bits))
            out += [(side, value, lower, upper, bound) for value, (upper, lower) in heap.held.items()]
            out.append((side, None, total, total, heap.floor))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["side", "value", "lower", "upper", "bound"])

    hashed = values.select("side", "value", F.xxhash64("value").alias("h"))
    combined = hashed.mapInArrow(combine, "side string, value string, h bigint, n bigint")
    found = combined.repartition("side", "value").mapInArrow(sketch, "side string, value string, lower bigint, upper bigint, bound bigint")
    # bounded, and read twice below
    found = written(found, "candidates")
    totals = found.filter("value is null").groupBy("side", "value").agg(F.sum("lower").alias("lower"), F.sum("upper").alias("upper"), F.max("bound").alias("bound"))
    return found.filter("value is not null").unionByName(totals)


def heavy(found: DataFrame, values: DataFrame, threshold: float) -> DataFrame:
    """side, value of the values with at least `threshold` occurrences, from the result of `candidates`.

    A candidate whose interval lies on one side of the threshold is decided; those
    in between, if any, are counted exactly in one more pass over `values`, joined
    before anything is shuffled. There are at most as many as the heaps hold. Where a
    full heap gave up a value whose estimate reached the threshold, the threshold is too
    low for its capacity; then every value is counted exactly, and none is lost.
    """
    floor = found.filter("value is null").agg(F.max("bound")).first()[0]
    if floor is not None and floor >= threshold:
        whole = values.filter("value is not null").groupBy("side", "value").agg(F.count(F.lit(1)).alias("n"))
        return whole.filter(F.col("n") >= threshold).select("side", "value")
    sure = found.filter((F.col("lower") >= threshold) & F.col("value").isNotNull()).select("side", "value")
    open_ = found.filter((F.col("lower") < threshold) & (F.col("upper") >= threshold) & F.col("value").isNotNull()).select("side", "value")
    if open_.isEmpty():
        return sure
    exact = values.join(open_, ["side", "value"], "left_semi").groupBy("side", "value").agg(F.count(F.lit(1)).alias("n"))
    return sure.unionByName(exact.filter(F.col("n") >= threshold).select("side", "value"))
