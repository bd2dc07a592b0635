"""Typed tables over block-numbered data: column types, entities and chains."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.functions import ledger as L

#: Default blocks per partition file (fixed values).
BLOCKS_PER_PARTITION = {"eth": 10_000, "polygon": 100_000}


@dataclass(frozen=True)
class ColumnType:
    """A logical type: its Spark type and, for fixed-length bytes, the length."""

    name: str
    spark: T.DataType
    length: int | None = None


VARCHAR = ColumnType("varchar", T.StringType())
U256 = ColumnType("u256", T.StringType())
I64 = ColumnType("i64", T.LongType())
U64 = ColumnType("u64", T.DecimalType(20, 0))
BLOCK_NUMBER = ColumnType("block_number", T.LongType())
FLOAT64 = ColumnType("float64", T.DoubleType())
BYTES = ColumnType("bytes", T.BinaryType())
BLOB = ColumnType("blob", T.BinaryType())
TIMESTAMP = ColumnType("timestamp", T.TimestampNTZType())


def fixed_bytes(length: int) -> ColumnType:
    """Bytes whose length is enforced."""
    return ColumnType(f"fixed_bytes({length})", T.BinaryType(), length)


@dataclass(frozen=True)
class ColumnSpec:
    """A column: name, type, nullability and the expression over the raw row that gives its value."""

    name: str
    type: ColumnType
    nullable: bool
    value: Column

    def projected(self) -> Column:
        """The cast value; null in a required column or a wrong length raises at run time."""
        v = self.value.cast(self.type.spark)
        if self.type.length is not None:
            v = F.when(v.isNull() | (F.length(v) == self.type.length), v).otherwise(F.raise_error(F.lit(f"{self.name}: expected {self.type.length} bytes")).cast("binary"))
        if not self.nullable:
            v = F.coalesce(v, F.raise_error(F.lit(f"{self.name}: null in a required column")).cast(self.type.spark))
        return v.alias(self.name)


@dataclass(frozen=True)
class EntitySpec:
    """A table of a chain. `block_column` must be one of its required integer columns."""

    name: str
    block_column: str
    columns: tuple[ColumnSpec, ...]
    #: Gives raw rows (dicts) for a list of block numbers; used where no index exists.
    fetch: Callable[[list[int]], Iterable[dict]] | None = None
    raw_schema: str | T.StructType | None = None

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if not names:
            raise ValueError(f"{self.name}: a table needs columns")
        if len(set(names)) < len(names):
            raise ValueError(f"{self.name}: column names repeat")
        own = {c.name: c for c in self.columns}.get(self.block_column)
        if own is None or own.nullable or not isinstance(own.type.spark, T.LongType):
            raise ValueError(f"{self.name}: {self.block_column} is no required integer column")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type.spark, c.nullable) for c in self.columns])

    def typed(self, raw: DataFrame) -> DataFrame:
        """Raw rows as rows of this table, checked."""
        return raw.select(*[c.projected() for c in self.columns])


@dataclass
class ChainSpec:
    """A chain is a namespace of tables with one head block."""

    name: str
    entities: dict[str, EntitySpec]
    head: Callable[[], int | None] = lambda: None
    blocks_per_partition: int = 10_000
    options: dict[str, str] = field(default_factory=dict)


RAW_BLOCK = "number string, hash string, timestamp string, baseFeePerGas string, difficulty string, totalDifficulty string, gasLimit string, parentHash string, nonce string, miner string, size string"
RAW_LOG = "blockNumber string, blockHash string, address string, data string, logIndex string, topics array<string>, transactionHash string, transactionIndex string"


def eth_blocks(fetch: Callable | None = None) -> EntitySpec:
    """Block headers from raw hex fields. Values that do not fit their type are null where allowed."""
    c = F.col
    return EntitySpec(
        "blocks", "number",
        (
            ColumnSpec("number", BLOCK_NUMBER, False, L.hex_to_int(c("number"))),
            ColumnSpec("hash", fixed_bytes(32), False, L.decode_hex(c("hash"))),
            ColumnSpec("timestamp", TIMESTAMP, True, L.epoch_to_ts(L.hex_to_int(c("timestamp")))),
            ColumnSpec("base_fee_per_gas", U64, True, L.hex_to_int(c("baseFeePerGas"))),
            ColumnSpec("difficulty", U64, True, L.hex_to_int(c("difficulty"))),
            ColumnSpec("total_difficulty", FLOAT64, True, L.hex_to_double(c("totalDifficulty"))),
            ColumnSpec("gas_limit", FLOAT64, True, L.hex_to_double(c("gasLimit"))),
            ColumnSpec("parent_hash", fixed_bytes(32), True, L.decode_hex(c("parentHash"))),
            ColumnSpec("nonce", BYTES, True, L.decode_hex(c("nonce"))),
            ColumnSpec("miner", fixed_bytes(20), True, L.decode_hex(c("miner"))),
            ColumnSpec("size", U64, True, L.hex_to_int(c("size"))),
        ),
        fetch, RAW_BLOCK,
    )


def eth_logs(fetch: Callable | None = None) -> EntitySpec:
    """Log records from raw hex fields, one row per log; topics beyond the fourth are dropped."""
    c = F.col
    return EntitySpec(
        "logs", "block_number",
        (
            ColumnSpec("block_number", BLOCK_NUMBER, False, L.hex_to_int(c("blockNumber"))),
            ColumnSpec("block_hash", fixed_bytes(32), False, L.decode_hex(c("blockHash"))),
            ColumnSpec("contract_address", fixed_bytes(20), True, L.decode_hex(c("address"))),
            ColumnSpec("data", BLOB, True, L.decode_hex(c("data"))),
            ColumnSpec("index", U64, False, L.hex_to_int(c("logIndex"))),
            *[ColumnSpec(f"topic{i + 1}", fixed_bytes(32), True, L.topic(c("topics"), i)) for i in range(4)],
            ColumnSpec("tx_hash", fixed_bytes(32), False, L.decode_hex(c("transactionHash"))),
            ColumnSpec("tx_index", U64, False, L.hex_to_int(c("transactionIndex"))),
        ),
        fetch, RAW_LOG,
    )
