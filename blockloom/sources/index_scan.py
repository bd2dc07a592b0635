"""Reading an indexed table: only the files, columns and row groups that can matter."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from blockloom.plans.pruning import classify, kept, surviving
from blockloom.sources.manifest import BlockPartition, TableIndex


def pruned_partitions(spark: SparkSession, index: TableIndex, filters: Sequence[str] = (), start: int | None = None, end: int | None = None) -> list[BlockPartition]:
    """Partitions with rows that overlap [start, end) and hold a block number that passes the block-only filters."""
    size = index.blocks_per_partition
    rows = [p for p in index.ordered() if p.row_count != 0 and (end is None or p.lower_bound < end) and (start is None or p.lower_bound + size > start)]
    pruners, _ = classify(spark, filters, index.block_column)
    bounds = [(max(p.lower_bound, start or 0), min(p.lower_bound + size, end) if end is not None else p.lower_bound + size) for p in rows]
    alive = surviving(spark, pruners, index.block_column, bounds)
    return [p for p, (low, _) in zip(rows, bounds, strict=True) if low in alive]


def enough(parts: Sequence[BlockPartition], limit: int) -> list[BlockPartition]:
    """The first partitions that together hold `limit` rows; those of unknown row counts stay and add nothing."""
    out, rows = [], 0
    for p in parts:
        if rows >= limit:
            break
        out.append(p)
        rows += p.row_count or 0
    return out


def read_files(spark: SparkSession, index: TableIndex, parts: Sequence[BlockPartition], readable: Callable[[str], str] = str) -> DataFrame:
    """The rows of partitions; without any, an empty table of the index's schema. readable: where the files can be read."""
    return spark.read.schema(index.schema).parquet(*[readable(p.location) for p in parts]) if parts else spark.createDataFrame([], index.schema)


def scan_index(spark: SparkSession, index: TableIndex, columns: Sequence[str] | None = None, filters: Sequence[str] = (), limit: int | None = None, start: int | None = None, end: int | None = None, readable: Callable[[str], str] = str) -> DataFrame:
    """An indexed table as a DataFrame, in no order.

    Files are chosen by `pruned_partitions`; every filter and bound is applied to the
    rows as well, where the reader pushes down what it can. Where nothing but a limit
    is asked for, files beyond those that hold enough rows are left out. With no file
    left the result is empty with the table's schema.
    """
    parts = pruned_partitions(spark, index, filters, start, end)
    if limit is not None and not filters and start is None and end is None:
        parts = enough(parts, limit)
    rows = read_files(spark, index, parts, readable)
    bounds = [f"`{index.block_column}` >= {start}"] * (start is not None) + [f"`{index.block_column}` < {end}"] * (end is not None)
    rows = kept(rows, [*bounds, *filters])
    if columns is not None:
        rows = rows.select(*columns)
    return rows if limit is None else rows.limit(limit)
