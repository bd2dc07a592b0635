"""Tables without an index, fetched block by block when they are read.

A Spark Python data source: the driver resolves which blocks are wanted, and each
read task fetches its share and converts it. Simple filters on the block column that
reach the source from SQL narrow its blocks; all filters are applied to the rows.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from blockloom.plans.blocks import BlockSet, batches, blocks_frame, resolve_bounds
from blockloom.plans.pruning import classify, kept
from blockloom.session import few, written
from blockloom.spec import ChainSpec, EntitySpec

#: Block numbers that the driver holds one by one at most; denser sets are kept as ranges anyway.
MAX_RANGES = 1_000_000


#: Asset descriptions, and the text of those that cannot be read.
ASSET = "name string, type string, symbol string, decimals int, description string, website string, explorer string, status string, links array<struct<name:string,url:string>>, _bad string"


@dataclass
class Blocks(InputPartition):
    ranges: tuple[tuple[int, int], ...]


class LiveReader(DataSourceReader):
    def __init__(self, schema, options):
        self.arrow = to_arrow_schema(schema)
        self.fetch = cloudpickle.loads(bytes.fromhex(options["fetch"]))
        self.blocks = BlockSet(tuple(tuple(r) for r in json.loads(options["ranges"])))
        self.column = options["column"]
        self.tasks, self.batch = int(options.get("tasks", "8")), int(options.get("blocksperbatch", "100"))

    def pushFilters(self, filters):
        """Narrow the blocks; every filter is handed back, so Spark applies it again."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.column,):
                if isinstance(f, EqualTo):
                    self.blocks = self.blocks.clip(f.value, f.value + 1)
                elif isinstance(f, GreaterThan):
                    self.blocks = self.blocks.clip(f.value + 1, 1 << 62)
                elif isinstance(f, GreaterThanOrEqual):
                    self.blocks = self.blocks.clip(f.value, 1 << 62)
                elif isinstance(f, LessThan):
                    self.blocks = self.blocks.clip(0, f.value)
                elif isinstance(f, LessThanOrEqual):
                    self.blocks = self.blocks.clip(0, f.value + 1)
                elif isinstance(f, In):
                    wanted = BlockSet.of(v for v in f.value if v is not None)
                    self.blocks = BlockSet(tuple(r for a, b in wanted.ranges for r in self.blocks.clip(a, b).ranges))
            yield f

    def partitions(self):
        return [Blocks(c.ranges) for c in self.blocks.chunks(self.tasks)] or [Blocks(())]

    def read(self, partition):
        for chunk in batches(BlockSet(partition.ranges), self.batch) if partition.ranges else []:
            rows = self.fetch(list(chunk))
            # a record batch at a time: no row is converted one by one on its way to the JVM
            columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in self.arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=self.arrow)


class LiveSource(DataSource):
    """Raw rows of a block set, by a function that fetches the rows of a list of numbers."""

    @classmethod
    def name(cls):
        return "blockloom_live"

    def schema(self):
        return self.options["schema"]

    def reader(self, schema):
        return LiveReader(schema, self.options)


def raw_live(spark: SparkSession, entity: EntitySpec, blocks: BlockSet, tasks: int = 8, blocks_per_batch: int = 100) -> DataFrame:
    """Raw rows of the given blocks."""
    if entity.fetch is None:
        raise ValueError(f"{entity.name} cannot be fetched")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LiveSource)
    schema = entity.raw_schema if isinstance(entity.raw_schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entity.raw_schema)
    options = {"schema": schema, "fetch": cloudpickle.dumps(entity.fetch).hex(), "ranges": json.dumps(blocks.ranges), "column": entity.block_column, "tasks": str(tasks), "blocksPerBatch": str(blocks_per_batch)}
    return spark.read.format("blockloom_live").options(**options).load()


def wanted_blocks(spark: SparkSession, entity: EntitySpec, filters: Sequence[str], head: int | None, start: int | None = None, end: int | None = None, last_n: int | None = None) -> BlockSet:
    """The block numbers within the bounds that pass the block-only filters."""
    pruners, _ = classify(spark, filters, entity.block_column)
    low, high = resolve_bounds(head, start, end, last_n, bool(pruners))
    if not pruners:
        return BlockSet.span(low, high)
    c = entity.block_column
    numbers = kept(blocks_frame(spark, BlockSet.span(low, high), c), pruners)
    # islands of survivors; only their ranges come to the driver
    spans = numbers.withColumn("_p", F.spark_partition_id()).withColumn("_g", F.col(c) - F.row_number().over(W.partitionBy("_p").orderBy(c))).groupBy("_p", "_g").agg(F.min(c).alias("a"), F.max(c).alias("b"))
    found = sorted((r.a, r.b + 1) for r in few(spans, MAX_RANGES))
    out: list[list[int]] = []
    for a, b in found:
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return BlockSet(tuple((a, b) for a, b in out))


def scan_live(spark: SparkSession, chain: ChainSpec, table: str, columns: Sequence[str] | None = None, filters: Sequence[str] = (), limit: int | None = None, start: int | None = None, end: int | None = None, last_n: int | None = None, tasks: int = 8, blocks_per_batch: int = 100) -> DataFrame:
    """A table without an index, sorted by block number.

    Needs a filter on the block number alone, last_n, or both start and end; they
    apply together, and the head block is included.
    """
    entity = chain.entities[table]
    blocks = wanted_blocks(spark, entity, filters, chain.head(), start, end, last_n)
    rows = entity.typed(raw_live(spark, entity, blocks, tasks, blocks_per_batch)) if len(blocks) else spark.createDataFrame([], entity.schema)
    rows = kept(rows, filters).orderBy(F.col(entity.block_column).asc_nulls_last())
    if columns is not None:
        rows = rows.select(*columns)
    return rows if limit is None else rows.limit(limit)


@dataclass(frozen=True)
class RpcConfig:
    """How to reach a JSON-RPC node; url may come from the environment."""

    url: str | None = None
    batch_size: int = 100
    max_concurrent: int = 10
    request_timeout_ms: int = 10_000


class RpcClient:
    """Batched JSON-RPC calls. Any failed item, a bad answer or a timeout is an error; nothing is retried."""

    def __init__(self, config: RpcConfig, post: Callable[[str, bytes, float], bytes] | None = None):
        if not config.url:
            raise ValueError("no RPC URL; set it in the configuration or the environment")
        self.config, self._post = config, post or _post

    def batch(self, method: str, calls: Sequence[list]) -> list:
        """Results of one method, in the order of the calls; None where the node has none."""
        if not calls:
            raise ValueError("no calls")
        groups = [calls[i : i + self.config.batch_size] for i in range(0, len(calls), self.config.batch_size)]
        with ThreadPoolExecutor(self.config.max_concurrent) as pool:
            return [r for g in pool.map(lambda g: self._one(method, g), groups) for r in g]

    def _one(self, method: str, calls: Sequence[list]) -> list:
        body = json.dumps([{"jsonrpc": "2.0", "id": i, "method": method, "params": p} for i, p in enumerate(calls)]).encode()
        answer = json.loads(self._post(self.config.url, body, self.config.request_timeout_ms / 1000))
        if not isinstance(answer, list) or {a.get("id") for a in answer} != set(range(len(calls))):
            raise RuntimeError(f"{method}: the answer does not match the calls")
        for a in answer:
            if a.get("error"):
                raise RuntimeError(f"{method}: {a['error']}")
        return [a.get("result") for a in sorted(answer, key=lambda a: a["id"])]

    def head(self) -> int:
        return int(self.batch("eth_blockNumber", [[]])[0], 16)

    def blocks(self, numbers: Iterable[int]) -> list[dict]:
        return [b for b in self.batch("eth_getBlockByNumber", [[hex(n), True] for n in numbers]) if b]

    def receipts(self, numbers: Iterable[int]) -> list[dict]:
        """Receipts of the blocks, flattened."""
        return [r for block in self.batch("eth_getBlockReceipts", [[hex(n)] for n in numbers]) for r in block or []]

    def logs(self, numbers: Iterable[int]) -> list[dict]:
        return [log for r in self.receipts(numbers) for log in r.get("logs") or []]

    def receipts_by_hash(self, hashes: Iterable[str]) -> list[dict]:
        return [r for r in self.batch("eth_getTransactionReceipt", [[h] for h in hashes]) if r]

    def traces(self, start: int, end: int) -> list[dict]:
        """Traces of the blocks in [start, end)."""
        return [t for block in self.batch("trace_block", [[hex(n)] for n in range(start, end)]) for t in block or []]


def nested_logs(receipts: DataFrame, column: str = "logs") -> DataFrame:
    """One row per log of receipts that hold theirs as an array of structs; a receipt without logs has none."""
    return receipts.select(*[c for c in receipts.columns if c != column], F.inline(column))


def _post(url: str, body: bytes, timeout: float) -> bytes:
    request = urllib.request.Request(url, body, {"content-type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        if answer.status != 200:
            raise RuntimeError(f"status {answer.status}")
        return answer.read()


def read_assets(spark: SparkSession, pattern: str) -> DataFrame:
    """Asset files (`.../<address>/info.json`) with their folder's name as address; unreadable ones are left out."""
    rows = spark.read.schema(ASSET).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(pattern)
    return written(rows.withColumn("address", F.regexp_extract(F.input_file_name(), "/([^/]+)/[^/]+$", 1))).filter("_bad is null").drop("_bad")


def load_chain(spark: SparkSession, base: str, name: str) -> tuple[dict, DataFrame]:
    """A chain's own description and its assets, from `base/name/info.json` and `base/name/assets/<address>/info.json`.

    A chain without a readable description is an error; unreadable assets are left out.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}/info.json")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(str(path))
    info = json.loads("".join(r.value for r in spark.read.text(str(path), wholetext=True).collect()))
    assets = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}/assets")
    pattern = f"{base}/{name}/assets/*/info.json"
    if fs.exists(assets) and fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)):
        return info, read_assets(spark, pattern)
    return info, spark.createDataFrame([], ASSET.removesuffix(", _bad string") + ", address string")


def batch_rows(rows: Iterable[tuple], limit: int | None) -> Iterator[tuple]:
    """Rows of a stream up to a limit; a limit of 0 gives none."""
    for i, row in enumerate(rows):
        if limit is not None and i >= limit:
            return
        yield row
