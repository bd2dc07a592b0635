"""The engine: chains as schemas, tables over an index or live data, SQL."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from blockloom.functions.dialect import register_dialect, translate
from blockloom.functions.ledger import register_current_block
from blockloom.plans.names import replaced
from blockloom.plans.pruning import is_pruner
from blockloom.session import scratch_path
from blockloom.sources.index_scan import pruned_partitions, read_files, scan_index
from blockloom.sources.live import scan_live
from blockloom.sources.manifest import Manifest
from blockloom.sources.storage import Location, PublishedStore, StorageConf, Store, open_store, store_for
from blockloom.spec import BLOCKS_PER_PARTITION, ChainSpec


@dataclass
class Config:
    """Chains and stores, as read from TOML."""

    app_data_dir: str = "~/.blockloom"
    chains: dict[str, dict] = field(default_factory=dict)
    stores: dict[str, StorageConf] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    @staticmethod
    def parse(text: str) -> Config:
        """A store that cannot be read is a warning; the chain eth is always there."""
        d = tomllib.loads(text)
        out = Config(d.get("app_data_dir", "~/.blockloom"), dict(d.get("chains", {})))
        for name, conf in d.get("stores", {}).items():
            try:
                out.stores[name] = StorageConf.parse(conf)
            except ValueError as e:
                out.warnings.append(f"store {name}: {e}")
        out.chains.setdefault("eth", {})
        return out

    @staticmethod
    def load(path: str) -> Config:
        """From a file; without one, the defaults."""
        if not os.path.exists(os.path.expanduser(path)):
            return Config.parse("")
        with open(os.path.expanduser(path), encoding="utf-8") as f:
            return Config.parse(f.read())

    def store_name(self, chain: str) -> str:
        """The store of a chain: its use_conf, else the one of its own name."""
        return self.chains.get(chain, {}).get("use_conf", chain)

    def rpc_url(self, chain: str) -> str | None:
        """The node's URL, else that of the chain's environment variable."""
        return self.chains.get(chain, {}).get("rpc", {}).get("url") or os.environ.get(f"{chain.upper()}_RPC_API")

    def blocks_per_partition(self, chain: str) -> int:
        return int(self.chains.get(chain, {}).get("blocks_per_partition", BLOCKS_PER_PARTITION.get(chain, 10_000)))


@dataclass
class Bounds:
    """Block window of a session: start inclusive, end exclusive, the last n blocks up to the head."""

    start: int | None = None
    end: int | None = None
    last_n: int | None = None

    def on_index(self, head: int | None) -> tuple[int | None, int | None]:
        low = self.start
        if self.last_n is not None and head is not None:
            low = max(low or 0, head + 1 - self.last_n)
        return low, self.end


class Engine:
    """Tables of the registered chains, by `chain.table`; the chain `default` needs no prefix."""

    def __init__(self, spark: SparkSession, default: str = "eth", blocks_per_batch: int = 100):
        self.spark, self.default, self.blocks_per_batch = spark, default, blocks_per_batch
        self.chains: dict[str, ChainSpec] = {}
        self.indexes: dict[str, Manifest] = {}
        self.bounds = Bounds()
        self.stores: list[StorageConf] = []
        self._stores: dict[StorageConf, Store | PublishedStore] = {}
        self._heads: dict[str, int] = {}
        self._empty: dict[str, str] = {}
        register_dialect(spark)

    def add_chain(self, chain: ChainSpec, index: Manifest | None = None) -> None:
        """Register a chain, perhaps with an index; its head is frozen for current_block until `refresh`."""
        self.chains[chain.name] = chain
        if index is not None:
            self.indexes[chain.name] = index
        self.refresh()

    def refresh(self) -> dict[str, str]:
        """Ask every chain for its head again; returns the errors of those that could not tell."""
        errors, self._heads = {}, {}
        for name, chain in self.chains.items():
            try:
                head = chain.head()
                if head is not None:
                    self._heads[name] = head
            except Exception as e:  # noqa: BLE001 - a chain without a head is left out
                errors[name] = str(e)
        register_current_block(self.spark, self._heads)
        return errors

    def head(self, chain: str) -> int | None:
        return self._heads.get(chain)

    def store(self, conf: StorageConf) -> Store | PublishedStore:
        """One store per configuration; one that cannot be opened is not kept."""
        if conf not in self._stores:
            self._stores[conf] = open_store(self.spark, conf)
        return self._stores[conf]

    def add_store(self, conf: StorageConf) -> None:
        """Configure a store. Once there is one, files that lie in none of them are refused."""
        if conf not in self.stores:
            self.stores.append(conf)

    def _readable(self, location: str) -> str:
        """Where Spark can read a partition file."""
        if not self.stores:
            return location
        return self.store(store_for(self.stores, Location(location))).readable(location)

    def set_window(self, start: int | None = None, end: int | None = None, last_n: int | None = None) -> None:
        """Limit every scan of the session to these blocks."""
        self.bounds = Bounds(start, end, last_n)

    def _split(self, name: str) -> tuple[str, str]:
        chain, _, table = name.rpartition(".")
        chain = chain or self.default
        if chain not in self.chains or table not in self.chains[chain].entities:
            raise LookupError(f"no table {chain}.{table}")
        return chain, table

    def tables(self) -> list[tuple[str, str]]:
        """(chain, table) of everything that can be queried."""
        return sorted((c.name, t) for c in self.chains.values() for t in c.entities)

    def describe(self, name: str) -> DataFrame:
        """Column names, types and whether null is allowed."""
        chain, table = self._split(name)
        rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in self.chains[chain].entities[table].schema.fields]
        return self.spark.createDataFrame(rows, "col_name string, data_type string, nullable boolean")

    def table(self, name: str, columns: Sequence[str] | None = None, filters: Sequence[str] = (), limit: int | None = None) -> DataFrame:
        """A table by its index where it has one, else fetched live."""
        chain, table = self._split(name)
        index = self.indexes[chain].table(table) if chain in self.indexes else None
        if index is not None:
            start, end = self.bounds.on_index(self.head(chain))
            return scan_index(self.spark, index, columns, filters, limit, start, end, self._readable)
        return scan_live(self.spark, self.chains[chain], table, columns, filters, limit, self.bounds.start, self.bounds.end, self.bounds.last_n, blocks_per_batch=self.blocks_per_batch)

    def files(self, name: str, filters: Sequence[str] = ()) -> list[str]:
        """The partition files that `table` would read."""
        chain, table = self._split(name)
        start, end = self.bounds.on_index(self.head(chain))
        return [p.location for p in pruned_partitions(self.spark, self.indexes[chain].table(table), filters, start, end)]

    def information_schema(self) -> dict[str, DataFrame]:
        """`tables` and `columns` of everything that can be queried."""
        cols = [(c, t, f.name, i + 1, f.dataType.simpleString(), f.nullable) for c, t in self.tables() for i, f in enumerate(self.chains[c].entities[t].schema.fields)]
        return {
            "tables": self.spark.createDataFrame(self.tables(), "table_schema string, table_name string"),
            "columns": self.spark.createDataFrame(cols, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable boolean"),
        }

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """A query over `chain.table` names, or bare names of the default chain; also
        `information_schema.tables` and `.columns`, SHOW TABLES, DESCRIBE and EXPLAIN, and
        the spellings of `functions.dialect`. args: values of its parameters, by name (`:x`)
        or in order (`?`).

        The query is planned once over empty tables. Conditions on the block column that
        the optimizer has put on a table's scan then choose its files, whatever their
        form, or, for a table without an index, the blocks to fetch; and the query is
        planned again over those. A table without an index needs such a condition or a
        window. EXPLAIN shows that second plan, as one row; without an index and a condition
        it shows the first.
        """
        asked = re.fullmatch(r"\s*(?:show\s+tables|(?:describe|desc)\s+(?:table\s+)?([\w.`]+))\s*;?\s*", text, re.I)
        if asked:
            return self.describe(asked[1].replace("`", "")) if asked[1] else self.information_schema()["tables"]
        asked = re.match(r"\s*explain(?:\s+(extended|codegen|cost|formatted))?\s+(?=\S)", text, re.I)
        if asked:
            plan = self._planned(text[asked.end() :], args, strict=False)._jdf.queryExecution()
            mode = getattr(self.spark._jvm.org.apache.spark.sql.execution, "ExplainMode").fromString((asked[1] or "simple").lower())
            return self.spark.createDataFrame([(plan.explainString(mode),)], "plan string")
        return self._planned(text, args)

    def _view_name(self, parts: list[str]) -> str | None:
        """The view of a table name: table, chain.table or main.chain.table."""
        low = [p.lower() for p in parts]
        if len(low) == 3 and low[0] == "main":
            low = low[1:]
        if len(low) == 1:
            low = [self.default, *low]
        if len(low) == 2 and low[0] == "information_schema" and low[1] in ("tables", "columns"):
            return f"information_schema__{low[1]}"
        known = {(c.lower(), t.lower()): f"{c}__{t}" for c, t in self.tables()}
        return known.get(tuple(low))

    def _planned(self, text: str, args: dict | list | None, strict: bool = True) -> DataFrame:
        plain, used = replaced(self.spark, translate(text.strip().rstrip(";")), self._view_name)
        views = {f"{c}__{t}": (c, t) for c, t in self.tables()}
        for v in used:
            if v.startswith("information_schema__"):
                self.information_schema()[v.removeprefix("information_schema__")].createOrReplaceTempView(v)
            else:
                self._placeholder(*views[v]).createOrReplaceTempView(v)
        used = [v for v in used if v in views]
        df = self.spark.sql(plain, args)
        if not used:
            return df
        found = _scan_conditions(df)
        for v in used:
            chain, table = views[v]
            column = self.chains[chain].entities[table].block_column
            # a table that is scanned twice keeps what either scan needs
            useful = [[c for c in s if is_pruner(self.spark, c, column)] for s in found.get(v, [])]
            condition = " OR ".join("(" + " AND ".join(f"({c})" for c in s) + ")" for s in useful) if useful and all(useful) else None
            try:
                self._rows(chain, table, condition).createOrReplaceTempView(v)
            except ValueError:
                if strict or self._indexed(chain, table):
                    raise
        return self.spark.sql(plain, args)

    def _indexed(self, chain: str, table: str) -> bool:
        return chain in self.indexes and self.indexes[chain].table(table) is not None

    def _rows(self, chain: str, table: str, condition: str | None) -> DataFrame:
        """What a condition on the block column leaves of a table."""
        filters = [condition] if condition else []
        if not self._indexed(chain, table):
            b = self.bounds
            return scan_live(self.spark, self.chains[chain], table, None, filters, None, b.start, b.end, b.last_n, blocks_per_batch=self.blocks_per_batch)
        index = self.indexes[chain].table(table)
        start, end = self.bounds.on_index(self.head(chain))
        df = read_files(self.spark, index, pruned_partitions(self.spark, index, filters, start, end), self._readable)
        if start is not None:
            df = df.filter(f"`{index.block_column}` >= {start}")
        if end is not None:
            df = df.filter(f"`{index.block_column}` < {end}")
        return df

    def _placeholder(self, chain: str, table: str) -> DataFrame:
        """An empty parquet table in a folder that tells its name, for planning."""
        key = f"{chain}/{table}"
        schema = (self.indexes[chain].table(table) if self._indexed(chain, table) else self.chains[chain].entities[table]).schema
        if key not in self._empty:
            self._empty[key] = f"{scratch_path(self.spark, 'plan')}/{key}/0.parquet"
            self.spark.createDataFrame([], schema).write.parquet(self._empty[key])
        return self.spark.read.schema(schema).parquet(self._empty[key])


def _scan_conditions(df: DataFrame) -> dict[str, list[list[str]]]:
    """Per view, for each of its scans in the optimized plan, the conditions right above it."""
    plan = df._jdf.queryExecution().optimizedPlan()
    out: dict[str, list[list[str]]] = {}

    def conditions(node) -> list[str]:
        if node.getClass().getSimpleName() == "And":
            return conditions(node.left()) + conditions(node.right())
        text, refs = node.sql(), node.references().toSeq()
        for i in range(refs.size()):
            text = text.replace(refs.apply(i).sql(), f"`{refs.apply(i).name()}`")
        return [text]

    def view_of(relation) -> str | None:
        paths = relation.relation().location().rootPaths()
        first = str(paths.head()) if paths.nonEmpty() else ""
        parts = first.rstrip("/").split("/")
        return f"{parts[-3]}__{parts[-2]}" if len(parts) > 2 else None

    def walk(node, above: list[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "LogicalRelation":
            try:
                v = view_of(node)
            except Exception:  # noqa: BLE001 - another kind of relation
                v = None
            if v:
                out.setdefault(v, []).append(above)
            return
        mine = conditions(node.condition()) if kind == "Filter" else above if kind == "Project" else []
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i), mine)

    try:
        walk(plan, [])
    except Exception:  # noqa: BLE001 - without conditions no file is left out
        return {}
    return out
