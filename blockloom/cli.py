"""Command line: build an index, show the configuration, run SQL."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from blockloom.engine import Config, Engine
from blockloom.operators.builder import build_index, load_or_create
from blockloom.sources.live import RpcClient, RpcConfig, scan_live
from blockloom.sources.manifest import Manifest
from blockloom.sources.storage import open_store
from blockloom.spec import ChainSpec, eth_blocks, eth_logs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="blockloom", description=__doc__)
    p.add_argument("--config", default="~/.blockloom/config.toml")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="build or extend an index")
    i.add_argument("--chain", required=True)
    i.add_argument("--store-conf", help="store name; the chain's name by default")
    i.add_argument("--start-block", type=int)
    i.add_argument("--end-block", type=int)
    i.add_argument("--blocks-per-partition", type=int)
    i.add_argument("--blocks-per-batch", type=int, default=1000)
    i.add_argument("--row-group-bytes", type=int, help="size of the row groups of the files")
    i.add_argument("--skip-tables", default="", help="names separated by commas")
    i.add_argument("--yes", action="store_true", help="never ask")
    sub.add_parser("config", help="show the configuration")
    s = sub.add_parser("sql", help="run a query, or read queries that end in a semicolon")
    s.add_argument("--command", dest="text")
    s.add_argument("--format", choices=("table", "csv", "json", "jsonl"), default="table")
    s.add_argument("--last-n-blocks", type=int)
    return p


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls included, in the column `value`."""
    return df.selectExpr("to_json(struct(*), map('ignoreNullFields', 'false')) as value")


def rendered(df: DataFrame, form: str) -> str:
    """The result as text. The caller asks for it as a whole, so it must fit the driver."""
    if form == "table":
        return df._jdf.showString(1 << 30, 0, False).rstrip("\n")
    if form == "csv":
        return df.toPandas().to_csv(index=False).rstrip("\n")
    rows = [r.value for r in json_lines(df).toLocalIterator()]
    return "\n".join(rows) if form == "jsonl" else "[" + ",".join(rows) + "]"


def chain_of(config: Config, name: str) -> ChainSpec:
    """A chain whose tables are fetched from its node."""
    url = config.rpc_url(name)
    rpc = RpcConfig(url, **{k: v for k, v in config.chains.get(name, {}).get("rpc", {}).items() if k in ("batch_size", "max_concurrent", "request_timeout_ms")})
    fetch_blocks = fetch_logs = None
    if url:
        fetch_blocks = lambda numbers: RpcClient(rpc).blocks(numbers)
        fetch_logs = lambda numbers: RpcClient(rpc).logs(numbers)
    tables = {"blocks": eth_blocks(fetch_blocks), "logs": eth_logs(fetch_logs)}
    return ChainSpec(name, tables, (lambda: RpcClient(rpc).head()) if url else (lambda: None), config.blocks_per_partition(name))


def open_engine(spark: SparkSession, config: Config) -> Engine:
    """All chains of the configuration, with their indexes; what cannot be opened is a warning."""
    engine = Engine(spark)
    for name in config.chains:
        index = None
        conf = config.stores.get(config.store_name(name))
        if conf is not None:
            engine.add_store(conf)
            try:
                text = engine.store(conf).load(conf.filename)
                index = Manifest.from_json(text) if text else None
            except (OSError, ValueError) as e:
                print(f"warning: store of {name}: {e}", file=sys.stderr)
        engine.add_chain(chain_of(config, name), index)
    return engine


def run_index(spark: SparkSession, config: Config, args: argparse.Namespace) -> int:
    chain = chain_of(config, args.chain)
    conf = config.stores.get(args.store_conf or config.store_name(args.chain))
    if conf is None:
        raise LookupError(f"no store for {args.chain}")
    store = open_store(spark, conf)
    size = args.blocks_per_partition or chain.blocks_per_partition
    manifest = load_or_create(store, chain.name, {t: (e.block_column, e.schema) for t, e in chain.entities.items()}, size)
    head = chain.head()
    if head is None:
        raise ValueError(f"the head of {args.chain} is not known")
    skip = [t.strip() for t in args.skip_tables.split(",") if t.strip()]
    if args.end_block is not None and args.end_block % size and not args.yes and sys.stdin.isatty():
        if input("the last partition will be incomplete, continue? [y/N] ").strip().lower() != "y":
            return 1

    def said(finished: list, done: int, total: int) -> None:
        for p in finished:
            print(f"{p.table} {p.lower_bound} {p.row_count} rows")
        print(f"{done} of {total} blocks", file=sys.stderr)

    report = build_index(
        spark, manifest, lambda t, a, b: scan_live(spark, chain, t, start=a, end=b, blocks_per_batch=args.blocks_per_batch),
        store, head, args.start_block, args.end_block, skip, stride=64, row_group_bytes=args.row_group_bytes, progress=said,
    )
    for table, start, error in report.failed:
        print(f"failed: {table} {start}: {error}", file=sys.stderr)
    return 1 if report.failed else 0


def statements(lines: Iterable[str]) -> Iterable[str]:
    """Statements that end in a semicolon at the end of a line, over as many lines as they take; `\\q` ends them."""
    held: list[str] = []
    for line in lines:
        if not held and line.strip() == "\\q":
            return
        held.append(line)
        if line.rstrip().endswith(";"):
            yield "".join(held)
            held = []
    if "".join(held).strip():
        yield "".join(held)


def repl(engine: Engine, lines: Iterable[str], form: str, prompt: bool = False) -> int:
    """Run each statement and go on after one that fails; 1 if any did."""
    failed = 0

    def prompted() -> Iterable[str]:
        while True:
            try:
                yield input("> ") + "\n"
            except EOFError:
                return

    for text in statements(prompted() if prompt else lines):
        if text.strip().strip(";"):
            try:
                print(rendered(engine.sql(text), form))
            except Exception as e:  # noqa: BLE001 - the next statement may be right
                print(f"error: {e}", file=sys.stderr)
                failed = 1
    return failed


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    config = Config.load(args.config)
    for w in config.warnings:
        print(f"warning: {w}", file=sys.stderr)
    if args.command == "config":
        print(f"app_data_dir = {config.app_data_dir}")
        for name in sorted(config.chains):
            print(f"chain {name}: store {config.store_name(name)}, {config.blocks_per_partition(name)} blocks per partition")
        for name, s in sorted(config.stores.items()):
            print(f"store {name}: {s.kind}")
        return 0
    spark = spark or SparkSession.builder.appName("blockloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.command == "index":
            return run_index(spark, config, args)
        engine = open_engine(spark, config)
        engine.set_window(last_n=args.last_n_blocks)
        if args.text:
            print(rendered(engine.sql(args.text), args.format))
            return 0
        return repl(engine, sys.stdin, args.format, sys.stdin.isatty())
    except Exception as e:  # noqa: BLE001 - a message and a status is all a shell can use
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
