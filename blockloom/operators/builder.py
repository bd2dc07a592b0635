"""Building and resuming an index of range-partitioned parquet files."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.sources.manifest import BlockPartition, Manifest, TableIndex
from blockloom.session import hadoop
from blockloom.sources.storage import PublishedStore, Store


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC).replace(tzinfo=None, microsecond=0)


def partition_path(chain: str, table: str, lower_bound: int) -> str:
    return f"{chain}/{table}/{lower_bound}.parquet"


def _bare_types(schema) -> list:
    return [(f.name, f.dataType) for f in schema.fields]


def build_partition(index: TableIndex, rows: DataFrame, store: Store | PublishedStore, chain: str, start: int, end: int) -> BlockPartition:
    """Write the rows of [start, end) as one file sorted by block number, and add it to the index.

    The start is checked before anything is written, and so is the schema. A range
    shorter than a partition is marked incomplete; building it again replaces it.
    """
    size = index.blocks_per_partition
    if start % size or not start < end <= start + size:
        raise ValueError(f"[{start}, {end}) is no partition of {size} blocks")
    if _bare_types(rows.schema) != _bare_types(index.schema):
        raise ValueError(f"{index.name}: the rows have another schema than the index")
    spark, c = rows.sparkSession, index.block_column
    # one task writes, but those that read keep their own parallelism
    rows = rows.filter((F.col(c) >= start) & (F.col(c) < end)).repartition(1).sortWithinPartitions(c)
    where = store.write_partition(rows, partition_path(chain, index.name, start))
    count = spark.read.schema(index.schema).parquet(store.readable(where)).count()
    made = BlockPartition(index.name, start, where, _now(), store.size(where), count, end - start < size)
    index.add(made)
    return made


def _files(spark: SparkSession, base: str) -> dict[int, frozenset[str]]:
    """The data files of each partition folder below `base`."""
    fs, path = hadoop(spark, base)
    if not fs.exists(path):
        return {}
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("lower_bound=")]
    return {int(p.getName().removeprefix("lower_bound=")): frozenset(s.getPath().getName() for s in fs.listStatus(p)) for p in found}


def build_range(index: TableIndex, rows: DataFrame, store: Store | PublishedStore, chain: str, start: int, end: int, row_group_bytes: int | None = None) -> list[BlockPartition]:
    """Write all partitions of [start, end) in one job, in place of those that are there.

    Rows are shuffled once, by the number of their partition, and sorted inside, so
    each task writes whole files and no block's rows are spread over files. Doing it
    again replaces the files, so a repeated build repeats no record. Of partitions
    without rows only the last of the range is recorded, with a row count of 0 and no
    file, as the next build starts behind it. row_group_bytes: size of
    the files' row groups, where the writer's own is not wanted.
    """
    size, c, spark = index.blocks_per_partition, index.block_column, rows.sparkSession
    if start % size:
        raise ValueError(f"{start} is no multiple of {size}")
    if _bare_types(rows.schema) != _bare_types(index.schema):
        raise ValueError(f"{index.name}: the rows have another schema than the index")
    if isinstance(store, PublishedStore):
        # files are addressed by content: one by one
        return [build_partition(index, rows, store, chain, low, min(low + size, end)) for low in range(start, end, size)]
    lower = (F.floor(F.col(c) / size) * size).cast("bigint")
    part = rows.filter((F.col(c) >= start) & (F.col(c) < end)).withColumn("lower_bound", lower)
    base = store.url(f"{chain}/{index.name}")
    before = _files(spark, base)
    writer = part.repartition("lower_bound").sortWithinPartitions("lower_bound", c).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lower_bound")
    (writer.option("parquet.block.size", row_group_bytes) if row_group_bytes else writer).parquet(base)
    now = _files(spark, base)
    # folders that this build did not write hold rows that are no longer there
    fresh = {low for low, files in now.items() if start <= low < end and files != before.get(low)}
    counts = {}
    if fresh:
        built = spark.read.schema(index.schema).option("basePath", base).parquet(*[f"{base}/lower_bound={low}" for low in sorted(fresh)])
        counts = {r.low: r.n for r in built.groupBy((F.floor(F.col(c) / size) * size).cast("bigint").alias("low")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for low in now:
        if start <= low < end and low not in fresh:
            fs, path = hadoop(spark, f"{base}/lower_bound={low}")
            fs.delete(path, True)
    for low in [low for low in index.partitions if start <= low < end]:
        del index.partitions[low]
    made = []
    for low in sorted(fresh | ({(end - 1) // size * size} if end > start else set())):
        where = f"{base}/lower_bound={low}"
        made.append(BlockPartition(index.name, low, where, _now(), store.size(where) if low in fresh else 0, counts.get(low, 0), end - low < size))
    for p in made:
        index.add(p)
    return made


@dataclass(frozen=True)
class Step:
    """What the build loop does next. kind: full, last, or done."""

    kind: str
    start: int
    end: int


def next_step(start: int, size: int, end: int | None, head: int) -> Step:
    """The next partition from `start`: whole ones while they fit below the end (or the head), then a shorter last one.

    Without an end the build stops behind the head.
    """
    stop = end if end is not None else head + 1
    if start >= stop:
        return Step("done", start, start)
    if start + size <= stop:
        return Step("last" if start + size == stop else "full", start, start + size)
    return Step("last", start, stop)


@dataclass
class BuildReport:
    finished: list[BlockPartition]
    failed: list[tuple[str, int, str]]


def load_or_create(store: Store | PublishedStore, chain: str, tables: dict[str, tuple[str, object]], blocks_per_partition: int) -> Manifest:
    """The store's manifest, whose chain must agree and whose partition size wins, or a new one with all tables."""
    text = store.load(store.conf.filename)
    if text:
        found = Manifest.from_json(text)
        if found.chain != chain:
            raise ValueError(f"the index is of chain {found.chain}, not {chain}")
        return found
    made = Manifest(chain, blocks_per_partition)
    for name, (column, schema) in tables.items():
        made.new_table(name, column, schema)
    return made


def build_index(spark: SparkSession, manifest: Manifest, rows: Callable[[str, int, int], DataFrame], store: Store | PublishedStore, head: int, start: int | None = None, end: int | None = None, skip: Sequence[str] = (), threads: int = 4, stride: int = 1, row_group_bytes: int | None = None, progress: Callable[[list[BlockPartition], int, int], None] | None = None) -> BuildReport:
    """Build the partitions of every table that is not skipped, from where the index ends.

    rows: gives a table's rows for a block range. Up to `stride` partitions are one
    job, and the tables of one range are built at the same time. If one of them
    fails, the build stops and the manifest keeps what was saved before; otherwise
    it is saved after each range, and `progress` gets the range's partitions, how many
    blocks are done, and of how many. A build that is repeated after a failure replaces
    what the failed one left.
    """
    size = manifest.blocks_per_partition
    todo = [manifest.tables[n] for n in manifest.names() if n not in skip]
    at = max(manifest.resume_block() if manifest.partition_count() else (start or 0), 0)
    if at % size:
        raise ValueError(f"{at} is no multiple of {size}")
    report = BuildReport([], [])
    first, stop = at, end if end is not None else head + 1
    while True:
        step = next_step(at, size, end, head)
        if step.kind == "done":
            return report
        while step.kind == "full" and step.end - at < stride * size and (more := next_step(step.end, size, end, head)).kind != "done":
            step = Step(more.kind, at, more.end)

        def one(index: TableIndex, step: Step = step) -> list[BlockPartition] | Exception:
            kept = dict(index.partitions)
            try:
                return build_range(index, rows(index.name, step.start, step.end), store, manifest.chain, step.start, step.end, row_group_bytes)
            except Exception as e:  # noqa: BLE001 - reported with the others
                index.partitions = kept
                return e

        with ThreadPoolExecutor(threads) as pool:
            for index, result in zip(todo, pool.map(one, todo), strict=True):
                if isinstance(result, Exception):
                    report.failed.append((index.name, step.start, str(result)))
                else:
                    report.finished += result
        if report.failed:
            return report
        store.save(store.conf.filename, manifest.to_json())
        if progress:
            progress([p for p in report.finished if p.lower_bound >= step.start], step.end - first, stop - first)
        if step.kind == "last":
            return report
        at = step.end
