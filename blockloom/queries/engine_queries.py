"""Queries on the engine's own operators: index, pruning, bounds, manifest, conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.engine import Engine
from blockloom.functions import ledger as L
from blockloom.operators.builder import build_index, build_range, load_or_create, next_step
from blockloom.cli import json_lines
from blockloom.operators.changes import newest
from blockloom.operators.compaction import fingerprint
from blockloom.plans.blocks import BlockSet, blocks_frame, islands
from blockloom.plans.pruning import classify, kept, merged
from blockloom.session import few, scratch_path, table
from blockloom.sources.index_scan import scan_index
from blockloom.sources.live import nested_logs, read_assets, scan_live
from blockloom.sources.manifest import BlockPartition, Manifest, TableIndex, load_partitions, save_partitions, upserted
from blockloom.sources.storage import StorageConf, Store
from blockloom.spec import BLOCK_NUMBER, BYTES, FLOAT64, TIMESTAMP, U64, ChainSpec, ColumnSpec, EntitySpec, fixed_bytes

#: Blocks per partition file of the indexes that the queries build.
SIZE = 500
INDEXED = {"blocks": "number", "logs": "block_number"}
_ENGINES: dict[tuple[str, str], Engine] = {}


def _store(spark: SparkSession, name: str) -> Store:
    path = scratch_path(spark, name)
    return Store(spark, StorageConf("hadoop", path if ":" in path else f"file://{path}"))


def _head(spark: SparkSession, base: str) -> int:
    return table(spark, base, "blocks").agg(F.max("number")).first()[0]


def engine(spark: SparkSession, base: str) -> Engine:
    """An engine over an index of the blocks and logs tables, built once per session and folder."""
    key = (spark.sparkContext.applicationId, base)
    if key not in _ENGINES:
        head = _head(spark, base)
        frames = {n: table(spark, base, n) for n in INDEXED}
        manifest = Manifest("eth", SIZE)
        store = _store(spark, "index")
        entities = {}
        for name, column in INDEXED.items():
            index = manifest.new_table(name, column, frames[name].schema)
            # a table may reach beyond the head: early references
            low, high = frames[name].agg(F.min(column), F.max(column)).first()
            build_range(index, frames[name], store, "eth", low // SIZE * SIZE, high + 1)
            entities[name] = _entity(name, column, frames[name].schema)
        made = Engine(spark)
        made.add_chain(ChainSpec("eth", entities, lambda: head, SIZE), manifest)
        _ENGINES[key] = made
    return _ENGINES[key]


def _entity(name: str, column: str, schema: T.StructType) -> EntitySpec:
    types = {"BinaryType": BYTES, "DoubleType": FLOAT64, "TimestampNTZType": TIMESTAMP, "LongType": BLOCK_NUMBER}
    cols = tuple(ColumnSpec(f.name, types.get(type(f.dataType).__name__, U64), f.name != column, F.col(f.name)) for f in schema.fields)
    return EntitySpec(name, column, cols)


def flagship(spark: SparkSession, base: str) -> DataFrame:
    """Logs of the latest blocks, joined with their blocks."""
    return engine(spark, base).sql(
        """SELECT l.block_number, count(*) AS n_logs, count(DISTINCT l.contract_address) AS n_contracts
        FROM eth.logs l JOIN (SELECT DISTINCT hash, number FROM eth.blocks) b ON b.hash = l.block_hash AND b.number = l.block_number
        WHERE b.number >= current_block('eth') - 100 GROUP BY l.block_number"""
    )


def _synthetic(head: int) -> ChainSpec:
    """A chain whose only table is made from the block number, for scans without an index."""

    def fetch(numbers: list[int]) -> list[dict]:
        return [{"id": hex(n), "half": n // 2} for n in numbers]

    cols = (ColumnSpec("id", BLOCK_NUMBER, False, L.hex_to_int(F.col("id"))), ColumnSpec("half", BLOCK_NUMBER, True, F.col("half")))
    return ChainSpec("made", {"t": EntitySpec("t", "id", cols, fetch, "id string, half bigint")}, lambda: head, SIZE)


def _live(filters=(), **bounds):
    def run(spark: SparkSession, base: str) -> DataFrame:
        return scan_live(spark, _synthetic(_head(spark, base)), "t", filters=list(filters), **bounds)

    return run


def _indexed(name: str, filters, columns):
    def run(spark: SparkSession, base: str) -> DataFrame:
        return engine(spark, base).table(name, columns, filters)

    return run


def scan_dispatch(spark: SparkSession, base: str) -> DataFrame:
    """The same call on an indexed table and on one without an index."""
    e = Engine(spark)
    known = engine(spark, base)
    e.add_chain(known.chains["eth"], known.indexes["eth"])
    e.add_chain(_synthetic(known.head("eth")))
    a = e.table("eth.blocks", ["number"], ["number >= 1000100"]).select(F.lit("indexed").alias("how"), "number")
    return a.unionByName(e.table("made.t", ["id"], ["id >= 1000100"]).select(F.lit("live").alias("how"), F.col("id").alias("number")))


def scan_sql(spark: SparkSession, base: str) -> DataFrame:
    return engine(spark, base).sql("SELECT number, miner IS NULL AS no_miner, gas_limit FROM eth.blocks WHERE number % 7 = 3 OR floor(number / 500) = 2001")


def sql_cte_shadow(spark: SparkSession, base: str) -> DataFrame:
    """A common table expression of a table's name hides it; its own body still reads the table."""
    return engine(spark, base).sql("WITH blocks AS (SELECT number AS x FROM blocks WHERE number % 2 = 0) SELECT count(*) AS n, min(x) AS low, max(x) AS high FROM blocks")


def sql_comma_join(spark: SparkSession, base: str) -> DataFrame:
    """Tables in a comma list, a comment and a text that look like tables, and columns qualified by schema and table."""
    return engine(spark, base).sql(
        """SELECT b.number, count(*) AS n, 'FROM logs' AS note /* FROM blocks */ FROM (SELECT DISTINCT number FROM blocks) b, eth.logs
        WHERE b.number = eth.logs.block_number AND logs.block_number % 3 = 1 -- FROM logs
        GROUP BY b.number"""
    )


def sql_args(spark: SparkSession, base: str) -> DataFrame:
    """Parameters by name, which prune like literals."""
    return engine(spark, base).sql("SELECT number FROM eth.blocks WHERE number >= :low AND number % :step = 0", {"low": 1_000_100, "step": 7})


def sql_explain(spark: SparkSession, base: str) -> DataFrame:
    """What EXPLAIN shows: one plan text, of the pruned plan, with the condition pushed to the scan."""
    shown = engine(spark, base).sql("EXPLAIN FORMATTED SELECT number FROM eth.blocks WHERE number >= 1000100")
    return shown.select(F.contains("plan", F.lit("== Physical Plan ==")).alias("physical"), F.contains("plan", F.lit("GreaterThanOrEqual(number,1000100)")).alias("pushed"), F.contains("plan", F.lit("/plan-")).alias("placeholder"))


def sql_dialect(spark: SparkSession, base: str) -> DataFrame:
    """Spellings of other engines over an indexed table."""
    return engine(spark, base).sql(
        """SELECT number, to_hex(number) AS hexed, strpos(to_hex(number), 'f4') AS place, starts_with(to_hex(number), 'f') AS f, lower(hex(sha256(to_hex(number)))) AS digest,
        to_hex(number) SIMILAR TO 'f(4|5)%' AS alike, date_bin(INTERVAL '15' MINUTE, block_timestamp, TIMESTAMP_NTZ'2001-01-01 00:00:00') AS bin FROM eth.blocks WHERE block_timestamp IS NOT NULL"""
    )


def bounds_last_n(spark: SparkSession, base: str) -> DataFrame:
    """The window applies to an indexed scan too."""
    known = engine(spark, base)
    e = Engine(spark)
    e.add_chain(known.chains["eth"], known.indexes["eth"])
    e.set_window(last_n=250)
    return e.table("logs", ["log_id", "block_number"])


def current_block(spark: SparkSession, base: str) -> DataFrame:
    engine(spark, base)
    return spark.sql("SELECT current_block('eth') AS head, current_block('nowhere') AS unknown, current_block(NULL) AS none")


def sql_files(spark: SparkSession, base: str) -> DataFrame:
    """Files that a free SQL query reads after its own conditions have chosen them."""
    e = engine(spark, base)
    texts = ["SELECT * FROM eth.blocks b WHERE floor(b.number / 500) % 2 = 0", "SELECT l.log_id FROM eth.logs l JOIN eth.blocks b ON l.block_number = b.number WHERE b.number % 1000 < 10 AND b.number < 1000500", "SELECT * FROM blocks WHERE hash IS NOT NULL"]
    return spark.createDataFrame([(t, len({f.rsplit("/", 1)[0] for f in e.sql(t).inputFiles()})) for t in texts], "query string, n_files bigint")


def prune_report(spark: SparkSession, base: str) -> DataFrame:
    """Files that each filter leaves to be read."""
    e = engine(spark, base)
    filters = ["floor(number / 500) % 2 = 0", "number < 1000500 OR number >= 1002000", "hash IS NOT NULL", "number BETWEEN 1000600 AND 1000700", "false"]
    rows = [(f, len(e.files("blocks", [f]))) for f in filters]
    return spark.createDataFrame(rows, "condition string, n_files bigint")


def prune_conjuncts(spark: SparkSession, base: str) -> DataFrame:
    """Which conjuncts prune."""
    tests = ["7 > 6", "number > 40 AND number < 90", "number > 40 AND gas_limit < 90", "floor(number / 64) > 3", "number IN (SELECT 1)", "rand() > 0.5", "sum(number) > 1", "CASE WHEN number > 5 THEN true END"]
    rows = [(t, *(len(x) for x in classify(spark, [t], "number"))) for t in tests]
    return spark.createDataFrame(rows, "condition string, n_pruners int, n_residual int")


def filter_and_fold(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "blocks").filter(merged(["number >= 1000100", "number >= 1000400", "size IS NOT NULL"])).select("number", F.col("size").cast("bigint").alias("size"))


def filter_sequence(spark: SparkSession, base: str) -> DataFrame:
    return kept(table(spark, base, "blocks"), ["number >= 1000100", "number >= 1000400", "size IS NOT NULL"]).select("number", F.col("size").cast("bigint").alias("size"))


def range_source(spark: SparkSession, base: str) -> DataFrame:
    """Every number from 0 to the head."""
    return blocks_frame(spark, BlockSet.span(0, _head(spark, base) + 1), "number")


def chunked_range(spark: SparkSession, base: str) -> DataFrame:
    """The numbers from 0 to the head in lossless chunks: their number and sizes."""
    whole = BlockSet.span(0, _head(spark, base) + 1)
    rows = [(i, len(c), c.ranges[0][0], c.ranges[-1][1] - 1) for i, c in enumerate(whole.chunks(7))]
    return spark.createDataFrame(rows, "chunk int, n bigint, first bigint, last bigint")


def build_partition(spark: SparkSession, base: str) -> DataFrame:
    m = engine(spark, base).indexes["eth"]
    return m.frame(spark).select(F.col("table").alias("table_name"), "lower_bound", "row_count", "incomplete")


def build_index_query(spark: SparkSession, base: str) -> DataFrame:
    """The build loop over blocks, partition by partition, resumed once."""
    blocks = table(spark, base, "blocks")
    head, size = _head(spark, base), 25_000
    store = _store(spark, "built")
    start = blocks.agg(F.min("number")).first()[0] // size * size
    tables = {"blocks": ("number", blocks.schema)}

    def rows(_: str, a: int, b: int) -> DataFrame:
        return blocks.filter((F.col("number") >= a) & (F.col("number") < b))

    build_index(spark, load_or_create(store, "eth", tables, size), rows, store, head, start, end=start + size // 2)
    again = load_or_create(store, "eth", tables, size)
    build_index(spark, again, rows, store, head)
    return again.frame(spark).select(F.col("table").alias("table_name"), "lower_bound", "row_count", "incomplete")


def iter_plan(spark: SparkSession, base: str) -> DataFrame:
    """The build loop's steps from 0 to the head."""
    head, at, rows = _head(spark, base), 0, []
    while (step := next_step(at, 100_000, None, head)).kind != "done":
        rows.append((step.kind, step.start, step.end))
        at = step.end
    return spark.createDataFrame(rows, "kind string, start_block bigint, end_block bigint")


def _entries(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "block_partitions")


def _newest(spark: SparkSession, base: str) -> DataFrame:
    return newest(_entries(spark, base), ["table_name", "lower_bound"], ["recorded_at", "entry_id"], ["byte_count", "row_count", "incomplete"])


def resume_block(spark: SparkSession, base: str) -> DataFrame:
    """Per table of the manifest, where its next build starts, and where the whole build resumes; a table without partitions asks for nothing."""
    last = _newest(spark, base).groupBy("table_name").agg(F.max_by(F.struct("lower_bound", "recorded_at", "byte_count", "row_count", "incomplete"), "lower_bound").alias("p"))
    m = Manifest("eth", 5)
    schema = T.StructType([T.StructField("number", T.LongType())])
    for r in few(last, 10_000):  # a row per table
        m.new_table(r.table_name, "number", schema).add(BlockPartition(r.table_name, r.p.lower_bound, "", r.p.recorded_at, r.p.byte_count, r.p.row_count, bool(r.p.incomplete)))
    m.new_table("skipped", "number", schema)
    rows = [(n, m.table(n).next_block(), m.resume_block()) for n in m.names() if m.table(n).partitions]
    return spark.createDataFrame(rows, "table_name string, next_block bigint, resumes_at bigint")


def manifest_upsert(spark: SparkSession, base: str) -> DataFrame:
    """Totals per table after every entry was upserted in the order recorded."""
    live = upserted(_entries(spark, base).select("table_name", "lower_bound", "recorded_at", "entry_id", "byte_count", "row_count"), ["recorded_at", "entry_id"], 5)
    return live.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_partitions"), F.sum("row_count").alias("total_rows"), F.sum("byte_count").alias("total_bytes"))


def merge_disjoint(spark: SparkSession, base: str) -> DataFrame:
    """Two indexes of disjoint halves of the blocks table, merged; overlapping ones are refused."""
    whole = engine(spark, base).indexes["eth"].table("blocks")
    half = len(whole.partitions) // 2
    a, b = (TableIndex("blocks", "number", SIZE, whole.schema, dict(x)) for x in (list(whole.partitions.items())[:half], list(whole.partitions.items())[half:]))
    a.merge(b)
    try:
        a.merge(b)
        refused = not b.partitions
    except ValueError:
        refused = True
    return spark.createDataFrame([(p.lower_bound, p.row_count, refused) for p in a.ordered()], "lower_bound bigint, row_count bigint, overlap_refused boolean")


def manifest_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """The live entries of each table as a manifest, saved, loaded, and listed; every field is compared."""
    store = _store(spark, "manifest")
    m = Manifest("eth", 5)
    live = newest(_entries(spark, base), ["table_name", "lower_bound"], ["recorded_at", "entry_id"], ["location", "created_at", "byte_count", "row_count", "incomplete"])
    rows = live.select(
        F.col("table_name").alias("table"), "lower_bound", "location", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "byte_count", "row_count", F.coalesce("incomplete", F.lit(False)).alias("incomplete")
    )
    for r in rows.select("table").distinct().collect():  # a row per table, however many entries
        m.new_table(r.table, "number", T.StructType([T.StructField("number", T.LongType())]))
    save_partitions(store, "index.json", m, rows)
    back, loaded = load_partitions(spark, store, "index.json")
    if back != m or fingerprint(loaded, rows.columns) != fingerprint(rows, rows.columns):
        raise RuntimeError("the loaded manifest differs from the saved one")
    return loaded.select(F.col("table").alias("table_name"), "lower_bound", "byte_count", "row_count", "incomplete")


def first_last_partition(spark: SparkSession, base: str) -> DataFrame:
    m = engine(spark, base).indexes["eth"]
    rows = [(n, m.table(n).first().lower_bound, m.table(n).last().lower_bound, m.table(n).last().row_count) for n in m.names()]
    return spark.createDataFrame(rows, "table_name string, first_bound bigint, last_bound bigint, last_rows bigint")


def partition_counts(spark: SparkSession, base: str) -> DataFrame:
    m = engine(spark, base).indexes["eth"]
    return spark.createDataFrame([(n, len(m.table(n).ids())) for n in m.names()], "table_name string, n_partitions bigint")


def partition_ids(spark: SparkSession, base: str) -> DataFrame:
    m = engine(spark, base).indexes["eth"]
    return spark.createDataFrame([(n, i) for n in m.names() for i in m.table(n).ids()], "table_name string, lower_bound bigint")


def partition_lookup(spark: SparkSession, base: str) -> DataFrame:
    m = engine(spark, base).indexes["eth"].table("logs")
    p = m.get(m.ids()[len(m.ids()) // 2])
    return spark.createDataFrame([(p.lower_bound, p.row_count, m.get(-5) is None)], "lower_bound bigint, row_count bigint, unknown_is_none boolean")


def partition_pages(spark: SparkSession, base: str) -> DataFrame:
    """The partitions in pages of 3."""
    m = engine(spark, base).indexes["eth"].table("blocks")
    rows = [(i, p.lower_bound) for i, page in enumerate(m.pages(3)) for p in page]
    return spark.createDataFrame(rows, "page int, lower_bound bigint")


def table_stats(spark: SparkSession, base: str) -> DataFrame:
    m = engine(spark, base).indexes["eth"]
    return spark.createDataFrame([(n, m.table(n).stats()[0]) for n in m.names()], "table_name string, total_rows bigint")


def sink_parquet(spark: SparkSession, base: str) -> DataFrame:
    """Write a table as partition files of 2000 blocks with row groups of 256 KiB, read them back."""
    logs = table(spark, base, "logs")
    index = TableIndex("logs", "block_number", 2000, logs.schema)
    low, high = logs.agg(F.min("block_number"), F.max("block_number")).first()
    build_range(index, logs, _store(spark, "sink"), "eth", low // 2000 * 2000, high + 1, row_group_bytes=256 << 10)
    return scan_index(spark, index, ["log_id", "block_number", "tx_hash"]).withColumn("tx_hash", F.lower(F.hex("tx_hash")))


def build_range_twice(spark: SparkSession, base: str) -> DataFrame:
    """The same range built twice, the second time with fewer rows: the second build's rows, each once."""
    blocks = table(spark, base, "blocks")
    index = TableIndex("blocks", "number", 2000, blocks.schema)
    low, high = blocks.agg(F.min("number"), F.max("number")).first()
    store = _store(spark, "twice")
    for rows in (blocks, blocks.filter("number % 2000 < 1900")):
        build_range(index, rows, store, "eth", low // 2000 * 2000, high + 1)
    total = sum(p.row_count for p in index.ordered())
    return scan_index(spark, index, ["number"]).groupBy("number").agg(F.count(F.lit(1)).alias("n")).withColumn("index_rows", F.lit(total).cast("bigint"))


def scan_limit(spark: SparkSession, base: str) -> DataFrame:
    """A limit alone leaves out the files behind those that hold enough rows."""
    e = engine(spark, base)
    df = e.table("logs", ["log_id"], limit=10)
    every = len(e.files("logs"))
    return spark.createDataFrame([(df.count(), len({f.rsplit("/", 1)[0] for f in df.inputFiles()}), every > 0)], "n_rows bigint, n_files bigint, has_files boolean")


def sorted_scan(spark: SparkSession, base: str) -> DataFrame:
    """An indexed table in the order of its blocks."""
    return engine(spark, base).table("logs", ["log_id", "block_number"]).orderBy(F.col("block_number").asc_nulls_last(), "log_id")


def typed_projection(spark: SparkSession, base: str) -> DataFrame:
    """All raw transactions as typed, checked columns."""
    c = F.col
    cols = (
        ColumnSpec("number", BLOCK_NUMBER, False, L.hex_to_int(c("block_number"))), ColumnSpec("gas", U64, True, L.hex_to_int(c("gas"))),
        ColumnSpec("from_addr", fixed_bytes(20), True, L.decode_hex(F.nullif(c("from_addr"), F.lit("")))),
    )
    typed = EntitySpec("txns", "number", cols).typed(table(spark, base, "txns"))
    return typed.select("number", F.col("gas").cast("bigint").alias("gas"), F.lower(F.hex("from_addr")).alias("from_addr"))


def _txns(columns):
    return lambda spark, base: table(spark, base, "txns").select("txn_id", *columns())


def topics(spark: SparkSession, base: str) -> DataFrame:
    """Topics by position from a list that may be short; beyond its end null."""
    listed = table(spark, base, "logs").select("log_id", F.array_compact(F.array(*[F.concat(F.lit("0x"), F.hex(f"topic{i}")) for i in (1, 2, 3, 4)])).alias("topics"))
    return listed.select("log_id", *[F.lower(F.hex(L.topic(F.col("topics"), i))).alias(f"t{i}") for i in range(4)])


def explode_nested(spark: SparkSession, base: str) -> DataFrame:
    """Receipts with nested logs, flattened to one row per log."""
    receipts = table(spark, base, "logs").groupBy("block_number", F.lower(F.hex("tx_hash")).alias("tx")).agg(F.collect_list(F.struct("log_id", F.col("log_index").cast("bigint").alias("log_index"))).alias("logs"))
    return nested_logs(receipts)


def json_permissive(spark: SparkSession, base: str) -> DataFrame:
    """One asset file per nation, every fifth of which is broken; readable ones come back with their folder's name."""
    out = scratch_path(spark, "assets")
    for r in few(table(spark, base, "nation"), 1000):
        text = f'{{"name": "{r.n_name}", "decimals": {r.n_nationkey}, "links": [{{"name": "x", "url": "y"}}]}}' if r.n_nationkey % 5 else "{broken"
        _store_text(spark, f"{out}/0x{r.n_nationkey}/info.json", text)
    return read_assets(spark, f"{out}/*/info.json").select("address", "name", "decimals", F.size("links").alias("n_links"))


def _store_text(spark: SparkSession, url: str, text: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(url)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(path, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def show_tables(spark: SparkSession, base: str) -> DataFrame:
    return spark.createDataFrame(engine(spark, base).tables(), "chain string, table_name string")


def describe_table(spark: SparkSession, base: str) -> DataFrame:
    return engine(spark, base).describe("eth.blocks")


def to_json_rows(spark: SparkSession, base: str) -> DataFrame:
    return json_lines(table(spark, base, "nation"))


_N = "'0x' || regexp_replace(lower({}), '^(0x|\\\\x)', '')"
_LONG = "(" + _N + ")::BIGINT"
_HEX = "regexp_replace({}, '^(0x|\\\\x)', '')"

QUERIES = {
    "flagship": flagship,
    "scan_dispatch": scan_dispatch,
    "scan_index": _indexed("logs", ["block_number >= 1000200", "topic1 IS NOT NULL"], ["log_id", "block_number"]),
    "scan_empty": _indexed("blocks", ["number < 0"], ["number"]),
    "scan_sql": scan_sql,
    "sql_files": sql_files,
    "sql_dialect": sql_dialect,
    "sql_cte_shadow": sql_cte_shadow,
    "sql_comma_join": sql_comma_join,
    "sql_args": sql_args,
    "sql_explain": sql_explain,
    "scan_selective": _live(["id % 1000 = 7 OR id < 20"]),
    "bounds_filter": _live(["id >= 999990", "half % 2 = 0"]),
    "bounds_last_n": bounds_last_n,
    "bounds_live_last_n": _live(last_n=100),
    "bounds_start_end": _live(start=1_000_000, end=1_000_321),
    "prune_floor": _indexed("blocks", ["floor(number / 500) % 2 = 0"], ["number"]),
    "prune_or": _indexed("blocks", ["number < 1000500 OR number >= 1002000"], ["number"]),
    "prune_multi": _indexed("blocks", ["number >= 1000100", "number >= 1000400", "gas_limit > 0"], ["number"]),
    "prune_report": prune_report,
    "prune_conjuncts": prune_conjuncts,
    "filter_and_fold": filter_and_fold,
    "filter_sequence": filter_sequence,
    "filter_residual": _indexed("logs", ["contract_address IS NOT NULL AND topic2 IS NULL"], ["log_id"]),
    "range_source": range_source,
    "chunked_range": chunked_range,
    "nums_to_ranges": lambda spark, base: islands(table(spark, base, "blocks"), "number"),
    "scan_limit": scan_limit,
    "build_range_twice": build_range_twice,
    "limit_n": lambda spark, base: table(spark, base, "logs").select("log_id", "block_number").orderBy("log_id").limit(10),
    "sorted_scan": sorted_scan,
    "max_blocknum": lambda spark, base: engine(spark, base).table("blocks", ["number"]).agg(F.max("number").alias("head")),
    "current_block": current_block,
    "build_partition": build_partition,
    "build_index": build_index_query,
    "iter_plan": iter_plan,
    "resume_block": resume_block,
    "partition_ids": partition_ids,
    "partition_counts": partition_counts,
    "partition_lookup": partition_lookup,
    "partition_pages": partition_pages,
    "first_last_partition": first_last_partition,
    "manifest_upsert": manifest_upsert,
    "manifest_round_trip": manifest_round_trip,
    "merge_disjoint": merge_disjoint,
    "table_stats": table_stats,
    "sink_parquet": sink_parquet,
    "table_api": lambda spark, base: engine(spark, base).table("eth.blocks").groupBy(F.lower(F.hex("miner")).alias("miner")).agg(F.count(F.lit(1)).alias("n_blocks")),
    "typed_projection": typed_projection,
    "decode_hex": _txns(lambda: [F.length(L.decode_hex(F.col("block_hash"))).cast("bigint").alias("n_bytes"), F.lower(F.hex(L.decode_hex(F.col("block_hash")))).alias("digits")]),
    "hex_to_int": _txns(lambda: [L.hex_to_int(F.col("gas")).cast("bigint").alias("gas"), L.hex_to_int(F.col("gas_price")).cast("bigint").alias("gas_price")]),
    "hex_to_u256": _txns(lambda: [L.hex_to_u256(F.col("value_wei")).alias("value_wei")]),
    "hex_to_u256_wide": _txns(lambda: [L.hex_to_u256(F.col("hash")).alias("hash"), L.hex_to_u256(F.col("r")).alias("r")]),
    "hex_to_double": _txns(lambda: [L.hex_to_double(F.col("gas_price")).alias("gas_price")]),
    "array_get": topics,
    "epoch_to_ts": lambda spark, base: table(spark, base, "blocks").select("number", L.epoch_to_ts(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', block_timestamp)")).alias("at")),
    "bytes_to_h": lambda spark, base: table(spark, base, "block_partitions").select("entry_id", L.bytes_to_h(F.col("byte_count")).alias("human")),
    "json_add_key": lambda spark, base: table(spark, base, "events").select("event_id", L.json_add_key(F.col("props"), "kind", F.col("event_type")).alias("doc")),
    "explode_nested": explode_nested,
    "json_permissive": json_permissive,
    "show_tables": show_tables,
    "describe_table": describe_table,
    "to_json_rows": to_json_rows,
}

_PART = "SELECT '{t}' table_name, (({c} // 500) * 500)::BIGINT lower_bound, count(*) row_count, {c} // 500 = (SELECT max({c}) + 1 FROM {t}) // 500 AND (SELECT max({c}) + 1 FROM {t}) % 500 <> 0 AS incomplete FROM {t} GROUP BY ALL"
_PARTS = f"WITH parts AS ({_PART.format(t='blocks', c='number')} UNION ALL {_PART.format(t='logs', c='block_number')})"
_LIVE = "WITH t AS (SELECT range id, range // 2 half FROM range((SELECT max(number) + 1 FROM blocks)))"
_LIVE_ENTRIES = "(SELECT * FROM block_partitions QUALIFY row_number() OVER (PARTITION BY table_name, lower_bound ORDER BY recorded_at DESC, entry_id DESC) = 1)"

ORACLE = {
    "flagship": "SELECT l.block_number, count(*) n_logs, count(DISTINCT l.contract_address) n_contracts FROM logs l JOIN (SELECT DISTINCT hash, number FROM blocks) b ON b.hash = l.block_hash AND b.number = l.block_number WHERE b.number >= (SELECT max(number) FROM blocks) - 100 GROUP BY 1",
    "scan_dispatch": _LIVE + " SELECT 'indexed' how, number FROM blocks WHERE number >= 1000100 UNION ALL SELECT 'live', id FROM t WHERE id >= 1000100",
    "scan_index": "SELECT log_id, block_number FROM logs WHERE block_number >= 1000200 AND topic1 IS NOT NULL",
    "scan_empty": "SELECT number FROM blocks WHERE number < 0",
    "scan_sql": "SELECT number, miner IS NULL no_miner, gas_limit FROM blocks WHERE number % 7 = 3 OR number // 500 = 2001",
    "sql_dialect": "SELECT number, lower(to_hex(number)) hexed, strpos(lower(to_hex(number)), 'f4')::INT place, starts_with(lower(to_hex(number)), 'f') f, sha256(lower(to_hex(number))) digest, regexp_full_match(lower(to_hex(number)), 'f(4|5).*') alike, time_bucket(INTERVAL '15 minutes', block_timestamp, TIMESTAMP '2001-01-01 00:00:00') bin FROM blocks WHERE block_timestamp IS NOT NULL",
    "scan_selective": _LIVE + " SELECT id, half FROM t WHERE id % 1000 = 7 OR id < 20",
    "bounds_filter": _LIVE + " SELECT id, half FROM t WHERE id >= 999990 AND half % 2 = 0",
    "bounds_last_n": "SELECT log_id, block_number FROM logs WHERE block_number > (SELECT max(number) FROM blocks) - 250",
    "bounds_live_last_n": _LIVE + " SELECT id, half FROM t ORDER BY id DESC LIMIT 100",
    "bounds_start_end": "SELECT range id, range // 2 half FROM range(1000000, least(1000321, (SELECT max(number) + 1 FROM blocks)))",
    "prune_floor": "SELECT number FROM blocks WHERE (number // 500) % 2 = 0",
    "prune_or": "SELECT number FROM blocks WHERE number < 1000500 OR number >= 1002000",
    "prune_report": _PARTS + """, p AS (SELECT lower_bound b FROM parts WHERE table_name = 'blocks')
SELECT 'floor(number / 500) % 2 = 0' AS "condition", count(*) n_files FROM p WHERE (b // 500) % 2 = 0
UNION ALL SELECT 'number < 1000500 OR number >= 1002000', count(*) FROM p WHERE b < 1000500 OR b + 500 > 1002000
UNION ALL SELECT 'hash IS NOT NULL', count(*) FROM p UNION ALL SELECT 'number BETWEEN 1000600 AND 1000700', count(*) FROM p WHERE b = 1000500 UNION ALL SELECT 'false', 0""",
    "prune_conjuncts": """SELECT * FROM (VALUES ('7 > 6', 1, 0), ('number > 40 AND number < 90', 2, 0), ('number > 40 AND gas_limit < 90', 1, 1), ('floor(number / 64) > 3', 1, 0),
('number IN (SELECT 1)', 0, 1), ('rand() > 0.5', 0, 1), ('sum(number) > 1', 0, 1), ('CASE WHEN number > 5 THEN true END', 1, 0)) t("condition", n_pruners, n_residual)""",
    "chunked_range": "WITH t AS (SELECT (SELECT max(number) + 1 FROM blocks) n), c AS (SELECT range::INT chunk, n // 7 + CASE WHEN range < n % 7 THEN 1 ELSE 0 END n FROM range(7), t), s AS (SELECT *, sum(n) OVER (ORDER BY chunk) stop FROM c) SELECT chunk, n, (stop - n)::BIGINT AS first, (stop - 1)::BIGINT AS last FROM s WHERE n > 0",
    "sql_cte_shadow": "SELECT count(*) n, min(number) low, max(number) high FROM blocks WHERE number % 2 = 0",
    "sql_comma_join": "SELECT block_number AS number, count(*) n, 'FROM logs' note FROM logs WHERE block_number IN (SELECT number FROM blocks) AND block_number % 3 = 1 GROUP BY 1",
    "sql_args": "SELECT number FROM blocks WHERE number >= 1000100 AND number % 7 = 0",
    "sql_explain": "SELECT true AS physical, true AS pushed, false AS placeholder",
    "scan_limit": "SELECT 10::BIGINT n_rows, 1::BIGINT n_files, true has_files",
    "build_range_twice": "WITH k AS (SELECT number, count(*) n FROM blocks WHERE number % 2000 < 1900 GROUP BY 1) SELECT *, (SELECT sum(n)::BIGINT FROM k) index_rows FROM k",
    "describe_table": "SELECT * FROM (VALUES ('number', 'bigint', false), ('hash', 'binary', true), ('block_timestamp', 'timestamp_ntz', true), ('base_fee_per_gas', 'decimal(20,0)', true), ('difficulty', 'decimal(20,0)', true), ('total_difficulty', 'double', true), ('gas_limit', 'double', true), ('parent_hash', 'binary', true), ('nonce', 'binary', true), ('miner', 'binary', true), ('size', 'decimal(20,0)', true), ('ingested_at', 'timestamp_ntz', true)) t(col_name, data_type, nullable)",
    "show_tables": "SELECT 'eth' AS chain, unnest(['blocks', 'logs']) table_name",
    "to_json_rows": "SELECT to_json(nation)::VARCHAR AS value FROM nation",
    "sql_files": _PARTS + """ SELECT 'SELECT * FROM eth.blocks b WHERE floor(b.number / 500) % 2 = 0' AS query, count(*) n_files FROM parts WHERE table_name = 'blocks' AND (lower_bound // 500) % 2 = 0
UNION ALL SELECT 'SELECT l.log_id FROM eth.logs l JOIN eth.blocks b ON l.block_number = b.number WHERE b.number % 1000 < 10 AND b.number < 1000500', count(*) FROM parts WHERE lower_bound = 1000000
UNION ALL SELECT 'SELECT * FROM blocks WHERE hash IS NOT NULL', count(*) FROM parts WHERE table_name = 'blocks'""",
    "prune_multi": "SELECT number FROM blocks WHERE number >= 1000400 AND gas_limit > 0",
    "filter_and_fold": "SELECT number, size::BIGINT size FROM blocks WHERE number >= 1000400 AND size IS NOT NULL",
    "filter_sequence": "SELECT number, size::BIGINT size FROM blocks WHERE number >= 1000400 AND size IS NOT NULL",
    "filter_residual": "SELECT log_id FROM logs WHERE contract_address IS NOT NULL AND topic2 IS NULL",
    "range_source": "SELECT range number FROM range((SELECT max(number) + 1 FROM blocks))",
    "nums_to_ranges": "WITH n AS (SELECT DISTINCT number n FROM blocks), g AS (SELECT n, n - row_number() OVER (ORDER BY n) g FROM n) SELECT min(n) range_start, max(n) + 1 range_end FROM g GROUP BY g",
    "limit_n": "SELECT log_id, block_number FROM logs ORDER BY log_id LIMIT 10",
    "sorted_scan": "SELECT log_id, block_number FROM logs ORDER BY block_number NULLS LAST, log_id",
    "max_blocknum": "SELECT max(number) head FROM blocks",
    "current_block": "SELECT max(number) head, NULL::BIGINT AS \"unknown\", NULL::BIGINT AS \"none\" FROM blocks",
    "build_partition": _PARTS + " SELECT * FROM parts",
    "build_index": "SELECT 'blocks' table_name, ((number // 25000) * 25000)::BIGINT lower_bound, count(*) row_count, number // 25000 = (SELECT max(number) + 1 FROM blocks) // 25000 AND (SELECT max(number) + 1 FROM blocks) % 25000 <> 0 AS incomplete FROM blocks GROUP BY ALL",
    "iter_plan": "WITH h AS (SELECT max(number) + 1 stop FROM blocks) SELECT CASE WHEN range + 100000 < stop THEN 'full' ELSE 'last' END kind, range start_block, least(range + 100000, stop) end_block FROM h, range(0, (SELECT stop FROM h), 100000)",
    "resume_block": f"SELECT table_name, CASE WHEN max_by(incomplete, lower_bound) THEN max(lower_bound) ELSE max(lower_bound) + 5 END next_block, min(next_block) OVER () resumes_at FROM {_LIVE_ENTRIES} GROUP BY 1",
    "partition_ids": _PARTS + " SELECT table_name, lower_bound FROM parts",
    "partition_counts": _PARTS + " SELECT table_name, count(*) n_partitions FROM parts GROUP BY 1",
    "partition_lookup": _PARTS + ", l AS (SELECT *, row_number() OVER (ORDER BY lower_bound) - 1 i, count(*) OVER () n FROM parts WHERE table_name = 'logs') SELECT lower_bound, row_count, true unknown_is_none FROM l WHERE i = n // 2",
    "partition_pages": _PARTS + " SELECT ((row_number() OVER (ORDER BY lower_bound) - 1) // 3)::INT page, lower_bound FROM parts WHERE table_name = 'blocks'",
    "first_last_partition": _PARTS + " SELECT table_name, min(lower_bound) first_bound, max(lower_bound) last_bound, max_by(row_count, lower_bound) last_rows FROM parts GROUP BY 1",
    "manifest_upsert": f"SELECT table_name, count(*) n_partitions, sum(row_count)::BIGINT total_rows, sum(byte_count)::BIGINT total_bytes FROM {_LIVE_ENTRIES} GROUP BY 1",
    "manifest_round_trip": f"SELECT table_name, lower_bound, byte_count, row_count, coalesce(incomplete, false) incomplete FROM {_LIVE_ENTRIES}",
    "merge_disjoint": _PARTS + " SELECT lower_bound, row_count, true overlap_refused FROM parts WHERE table_name = 'blocks'",
    "table_stats": _PARTS + " SELECT table_name, sum(row_count)::BIGINT total_rows FROM parts GROUP BY 1",
    "sink_parquet": "SELECT log_id, block_number, lower(hex(tx_hash)) tx_hash FROM logs",
    "table_api": "SELECT lower(hex(miner)) miner, count(*) n_blocks FROM blocks GROUP BY 1",
    "typed_projection": f"SELECT {_LONG.format('block_number')} number, {_LONG.format('gas')} gas, CASE WHEN length({_HEX.format('from_addr')}) > 0 AND from_addr <> '0x' THEN lower({_HEX.format('from_addr')}) END from_addr FROM txns",
    "decode_hex": f"SELECT txn_id, length({_HEX.format('block_hash')}) // 2 n_bytes, lower({_HEX.format('block_hash')}) digits FROM txns",
    "hex_to_int": f"SELECT txn_id, {_LONG.format('gas')} gas, {_LONG.format('gas_price')} gas_price FROM txns",
    "hex_to_u256": f"SELECT txn_id, ({_N.format('value_wei')})::HUGEINT::VARCHAR value_wei FROM txns",
    "hex_to_double": f"SELECT txn_id, {_LONG.format('gas_price')}::DOUBLE gas_price FROM txns",
    "array_get": "WITH l AS (SELECT log_id, list_filter([topic1, topic2, topic3, topic4], lambda x: x IS NOT NULL) t FROM logs) SELECT log_id, lower(hex(t[1])) t0, lower(hex(t[2])) t1, lower(hex(t[3])) t2, lower(hex(t[4])) t3 FROM l",
    "epoch_to_ts": "SELECT number, date_trunc('second', block_timestamp) AS \"at\" FROM blocks",
    "bytes_to_h": "SELECT entry_id, CASE WHEN byte_count < 1024 THEN printf('%.2fB', byte_count::DOUBLE) WHEN byte_count < 1048576 THEN printf('%.2fKB', byte_count / 1024.0::DOUBLE) WHEN byte_count < 1073741824 THEN printf('%.2fMB', byte_count / 1048576.0::DOUBLE) WHEN byte_count IS NOT NULL THEN printf('%.2fGB', byte_count / 1073741824.0::DOUBLE) END human FROM block_partitions",
    "json_add_key": "SELECT event_id, json_merge_patch(props, json_object('kind', event_type))::VARCHAR doc FROM events",
    "explode_nested": "SELECT block_number, lower(hex(tx_hash)) tx, log_id, log_index::BIGINT log_index FROM logs",
    "json_permissive": "SELECT '0x' || n_nationkey address, n_name AS name, n_nationkey decimals, 1::INT n_links FROM nation WHERE n_nationkey % 5 <> 0",
}
