"""The manifest: which partition files make up an indexed table.

A manifest is small (a row per file), kept in memory and saved as one JSON text;
partition files are always written before the manifest that names them. One of too many
files for that has its partitions as rows, which the executors write and read as JSON
lines; the text then names their folder.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.sources.storage import Store

ROW = "table string, lower_bound bigint, location string, created_at timestamp_ntz, byte_count bigint, row_count bigint, incomplete boolean"
#: Timestamps of partitions saved as lines, whole to the microsecond.
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


@dataclass(frozen=True)
class BlockPartition:
    """One file, covering [lower_bound, lower_bound + blocks per partition) of a table."""

    table: str
    lower_bound: int
    location: str
    created_at: datetime.datetime
    byte_count: int | None = None
    row_count: int | None = None
    incomplete: bool = False


@dataclass
class TableIndex:
    """The partitions of one table, by lower bound."""

    name: str
    block_column: str
    blocks_per_partition: int
    schema: T.StructType
    partitions: dict[int, BlockPartition] = field(default_factory=dict)

    def add(self, p: BlockPartition) -> None:
        """Insert or replace the partition of a lower bound."""
        if p.table != self.name:
            raise ValueError(f"partition of {p.table}, not of {self.name}")
        if p.lower_bound % self.blocks_per_partition:
            raise ValueError(f"{p.lower_bound} is no multiple of {self.blocks_per_partition}")
        self.partitions[p.lower_bound] = p

    def ordered(self) -> list[BlockPartition]:
        return [self.partitions[k] for k in sorted(self.partitions)]

    def pages(self, size: int) -> Iterator[list[BlockPartition]]:
        """Partitions in order of lower bound, `size` at a time."""
        rows = self.ordered()
        for i in range(0, len(rows), max(1, size)):
            yield rows[i : i + max(1, size)]

    def ids(self) -> list[int]:
        return sorted(self.partitions)

    def get(self, lower_bound: int) -> BlockPartition | None:
        return self.partitions.get(lower_bound)

    def first(self) -> BlockPartition | None:
        return min(self.partitions.values(), key=lambda p: p.lower_bound, default=None)

    def last(self) -> BlockPartition | None:
        return max(self.partitions.values(), key=lambda p: p.lower_bound, default=None)

    def stats(self) -> tuple[int, int]:
        """Rows and bytes of all partitions; unknown ones count 0."""
        return sum(p.row_count or 0 for p in self.partitions.values()), sum(p.byte_count or 0 for p in self.partitions.values())

    def merge(self, other: TableIndex) -> None:
        """Take over the partitions of an index of the same table and partition size; shared lower bounds are an error."""
        if (self.name, self.blocks_per_partition) != (other.name, other.blocks_per_partition):
            raise ValueError("the indexes differ in table or partition size")
        both = set(self.partitions) & set(other.partitions)
        if both:
            raise ValueError(f"both indexes have {sorted(both)[:5]}")
        self.partitions.update(other.partitions)

    def next_block(self) -> int:
        """Where the next build starts: at an incomplete last partition, else behind it, else at 0."""
        last = self.last()
        return 0 if last is None else last.lower_bound if last.incomplete else last.lower_bound + self.blocks_per_partition


@dataclass
class Manifest:
    """The indexed tables of one chain, with free metadata."""

    chain: str
    blocks_per_partition: int
    tables: dict[str, TableIndex] = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)

    def new_table(self, name: str, block_column: str, schema: T.StructType) -> TableIndex:
        if name in self.tables:
            raise ValueError(f"{name} exists")
        self.tables[name] = TableIndex(name, block_column, self.blocks_per_partition, schema)
        return self.tables[name]

    def table(self, name: str) -> TableIndex | None:
        return self.tables.get(name)

    def names(self) -> list[str]:
        return sorted(self.tables)

    def partition_count(self) -> int:
        return sum(len(t.partitions) for t in self.tables.values())

    def resume_block(self) -> int:
        """The earliest block that some table still needs; one without any partition was skipped and asks for nothing."""
        return min((t.next_block() for t in self.tables.values() if t.partitions), default=0)

    def is_valid(self) -> bool:
        return self.blocks_per_partition > 0 and all(n == t.name and t.block_column in t.schema.names and t.blocks_per_partition == self.blocks_per_partition for n, t in self.tables.items())

    def frame(self, spark: SparkSession) -> DataFrame:
        """All partitions as rows."""
        rows = [tuple(asdict(p).values()) for n in self.names() for p in self.tables[n].ordered()]
        return spark.createDataFrame(rows, ROW)

    def to_json(self) -> str:
        return json.dumps(
            {
                "chain": self.chain, "blocks_per_partition": self.blocks_per_partition, "metadata": self.metadata,
                "tables": [
                    {"name": t.name, "block_column": t.block_column, "schema": t.schema.jsonValue(), "partitions": [asdict(p) | {"created_at": p.created_at.isoformat()} for p in t.ordered()]}
                    for t in self.tables.values()
                ],
            }
        )

    @staticmethod
    def from_json(text: str) -> Manifest:
        d = json.loads(text)
        out = Manifest(d["chain"], d["blocks_per_partition"], metadata=d["metadata"])
        for t in d["tables"]:
            index = out.new_table(t["name"], t["block_column"], T.StructType.fromJson(t["schema"]))
            for p in t["partitions"]:
                index.add(BlockPartition(**{**p, "created_at": datetime.datetime.fromisoformat(p["created_at"])}))
        return out


def upserted(entries: DataFrame, order: Sequence[str], blocks_per_partition: int) -> DataFrame:
    """What `TableIndex.add` leaves when all entries are added in `order`: the last of each table and lower bound.

    entries: `table_name, lower_bound` and what they are to keep. A null lower bound or
    one that is no multiple of `blocks_per_partition` is an error, as there. Entries that tie
    in `order` are told apart by their other columns.
    """
    size = blocks_per_partition
    message = F.concat(F.coalesce(F.col("lower_bound").cast("string"), F.lit("null")), F.lit(f" is no multiple of {size}"))
    bound = F.when(F.col("lower_bound") % size == 0, F.col("lower_bound")).otherwise(F.raise_error(message).cast("bigint"))
    kept = [c for c in entries.columns if c not in ("table_name", "lower_bound", *order)]
    last = entries.withColumn("lower_bound", bound).groupBy("table_name", "lower_bound").agg(F.max(F.struct(*order, *kept)).alias("_last"))
    return last.select("table_name", "lower_bound", "_last.*")


def save_partitions(store: Store, name: str, manifest: Manifest, partitions: DataFrame) -> None:
    """Save a manifest with partitions that are rows (`ROW`), of any number, one per table and lower bound.

    Nothing is sent to the driver. A lower bound that is null or no multiple of the
    partition size is an error. The lines are written before the text that names them.
    """
    size = manifest.blocks_per_partition
    message = F.concat(F.coalesce(F.col("lower_bound").cast("string"), F.lit("null")), F.lit(f" is no multiple of {size}"))
    bound = F.when(F.col("lower_bound") % size == 0, F.col("lower_bound")).otherwise(F.raise_error(message).cast("bigint"))
    folder = f"{name}.partitions-{uuid.uuid4().hex}"
    partitions.withColumn("lower_bound", bound).write.option("timestampNTZFormat", STAMP).json(store.url(folder))
    manifest.metadata["partitions"] = folder
    store.save(name, manifest.to_json())


def load_partitions(spark: SparkSession, store: Store, name: str) -> tuple[Manifest, DataFrame]:
    """A manifest saved by `save_partitions`, and its partitions as rows."""
    manifest = Manifest.from_json(store.load(name))
    return manifest, spark.read.schema(ROW).options(mode="FAILFAST", timestampNTZFormat=STAMP).json(store.url(manifest.metadata["partitions"]))
