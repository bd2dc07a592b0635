"""Sets of block numbers: ranges, lossless chunks, islands and scan bounds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BlockSet:
    """Sorted, disjoint, half-open ranges of block numbers."""

    ranges: tuple[tuple[int, int], ...] = ()

    @staticmethod
    def span(start: int, end: int) -> BlockSet:
        """[start, end); empty where end is not above start."""
        return BlockSet(((start, end),) if end > start else ())

    @staticmethod
    def of(numbers: Iterable[int]) -> BlockSet:
        """The set of the given numbers; order and repeats do not matter."""
        out: list[list[int]] = []
        for n in sorted(set(numbers)):
            if out and out[-1][1] == n:
                out[-1][1] = n + 1
            else:
                out.append([n, n + 1])
        return BlockSet(tuple((a, b) for a, b in out))

    def __len__(self) -> int:
        return sum(b - a for a, b in self.ranges)

    def __iter__(self) -> Iterator[int]:
        for a, b in self.ranges:
            yield from range(a, b)

    def clip(self, start: int, end: int) -> BlockSet:
        """What lies in [start, end)."""
        return BlockSet(tuple((max(a, start), min(b, end)) for a, b in self.ranges if max(a, start) < min(b, end)))

    def chunks(self, n: int) -> list[BlockSet]:
        """At most n sets in order, of sizes that differ by at most one; together they are the whole set."""
        total, n = len(self), max(1, n)
        n = min(n, total)
        sizes = [total // n + (i < total % n) for i in range(n)] if n else []
        out, rest = [], list(self.ranges)
        for size in sizes:
            part = []
            while size:
                a, b = rest.pop(0)
                take = min(size, b - a)
                part.append((a, a + take))
                size -= take
                if a + take < b:
                    rest.insert(0, (a + take, b))
            out.append(BlockSet(tuple(part)))
        return out


def blocks_frame(spark: SparkSession, blocks: BlockSet, column: str) -> DataFrame:
    """One column with every number of the set; made on the executors."""
    if not blocks.ranges:
        return spark.range(0).select(F.col("id").alias(column))
    if len(blocks.ranges) == 1:
        return spark.range(*blocks.ranges[0]).select(F.col("id").alias(column))
    spans = spark.createDataFrame([(a, b - 1) for a, b in blocks.ranges], "a bigint, b bigint")
    return spans.select(F.explode(F.sequence("a", "b")).alias(column))


def islands(df: DataFrame, column: str, width: int = 1 << 20) -> DataFrame:
    """Half-open ranges `range_start, range_end` of the distinct numbers in a column; nulls are left out.

    Gaps are found inside stretches of `width` numbers, each summed in one task, and
    the islands of neighbouring stretches that touch are joined afterwards.
    """
    n = df.select(F.col(column).cast("bigint").alias("n")).filter("n is not null").distinct().withColumn("_s", F.floor(F.col("n") / width))
    inner = n.withColumn("_g", F.col("n") - F.row_number().over(W.partitionBy("_s").orderBy("n"))).groupBy("_s", "_g").agg(F.min("n").alias("a"), (F.max("n") + 1).alias("b"))
    # only islands that reach the border of their stretch can touch another: two a stretch
    edge = (F.col("a") % width == 0) | (F.col("b") % width == 0)
    order = W.orderBy("a")
    opened = inner.filter(edge).withColumn("_new", (F.lag("b").over(order) != F.col("a")).cast("int"))
    joined = opened.withColumn("_i", F.sum(F.coalesce("_new", F.lit(1))).over(order)).groupBy("_i").agg(F.min("a").alias("range_start"), F.max("b").alias("range_end")).drop("_i")
    return inner.filter(~edge).select(F.col("a").alias("range_start"), F.col("b").alias("range_end")).unionByName(joined)


def resolve_bounds(head: int | None, start: int | None = None, end: int | None = None, last_n: int | None = None, has_filter: bool = False) -> tuple[int, int]:
    """The half-open block bounds of a scan of live data.

    start (inclusive) and end (exclusive) and the last `last_n` blocks up to and
    including the head all apply together. Without any of them a filter on the block
    number is required, and the scan reaches from 0 to the head. Bounds are never
    negative and may be empty; where the head is needed but unknown it is an error.
    """
    if start is None and end is None and last_n is None and not has_filter:
        raise ValueError("give start and end, last_n, or a filter on the block number")
    if last_n is None and not has_filter and (start is None or end is None):
        raise ValueError("give both start and end")
    if head is None and (end is None or last_n is not None):
        raise ValueError("the head block is not known")
    low = max(0, start or 0, *([head + 1 - last_n] if last_n is not None else []))
    high = min(x for x in (end, head + 1 if head is not None else None) if x is not None)
    return low, max(low, high)


def batches(blocks: BlockSet, blocks_per_batch: int) -> list[BlockSet]:
    """The set cut into batches of about `blocks_per_batch` numbers."""
    return blocks.chunks(max(1, -(-len(blocks) // max(1, blocks_per_batch))))


def lossless(parts: Sequence[BlockSet]) -> BlockSet:
    """The union of sets."""
    return BlockSet.of(n for p in parts for n in p)
