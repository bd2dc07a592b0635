import datetime
import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom import cli
from blockloom.engine import Config, Engine
from blockloom.functions import ledger as L
from blockloom.functions.dialect import translate
from blockloom.plans.names import replaced
from blockloom.operators.builder import build_index, build_partition, build_range, load_or_create
from blockloom.sources.index_scan import scan_index
from blockloom.sources.live import RpcClient, RpcConfig, batch_rows, load_chain, read_assets, scan_live
from blockloom.sources.manifest import BlockPartition, Manifest, upserted
from blockloom.sources.storage import Location, StorageConf, Store, location_parts, store_for
from blockloom.spec import BLOCK_NUMBER, U256, VARCHAR, ChainSpec, ColumnSpec, EntitySpec, eth_blocks, eth_logs, fixed_bytes

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
WHEN = datetime.datetime(2024, 1, 1)


def part(low, table="t", **kw):
    return BlockPartition(table, low, "file:///", WHEN, 1, 1, **kw)


def index(size=100):
    return Manifest("c", size).new_table("t", "id", SCHEMA)


def test_manifest():
    t = index()
    for low in (0, 0, 100):
        t.add(part(low))
    assert t.ids() == [0, 100] and t.stats() == (2, 2) and t.get(5) is None
    assert t.first().lower_bound == 0 and t.last().lower_bound == 100 and index().last() is None
    for bad in (part(99), part(0, "other")):
        with pytest.raises(ValueError):
            t.add(bad)
    pages = index()
    for i in range(100):
        pages.add(part(100 * i))
    assert [p[0].lower_bound for p in pages.pages(10)] == [1000 * k for k in range(10)]


def test_merge():
    a, b = index(), index()
    a.add(part(0))
    b.add(part(100))
    b.add(part(200))
    a.merge(b)
    assert len(a.ids()) == 3
    for bad in (b, index(10), Manifest("c", 100).new_table("u", "id", SCHEMA)):
        with pytest.raises(ValueError):
            a.merge(bad)


def test_round_trip(spark):
    m = Manifest("c", 10, metadata={"k": "v"})
    m.new_table("t", "id", SCHEMA).add(part(20, incomplete=True))
    back = Manifest.from_json(m.to_json())
    assert back == m and back.is_valid() and back.resume_block() == 20
    assert m.frame(spark).count() == 1 and Manifest("c", 1).frame(spark).count() == 0
    with pytest.raises(ValueError):
        m.new_table("t", "id", SCHEMA)
    back.table("t").add(part(20))
    assert back.resume_block() == 30 and back.table("x") is None


def rows(spark, a, b):
    return spark.range(a, b).select("id", F.lit("test").alias("text"))


def test_build_and_scan(spark, tmp_path):
    store = Store(spark, StorageConf("file", str(tmp_path)))
    t = index()
    made = build_range(t, rows(spark, 0, 1000), store, "c", 0, 950)
    assert len(made) == 10 and made[-1].incomplete and not made[0].incomplete and sum(p.row_count for p in made) == 950
    df = scan_index(spark, t, ["id"], ["floor(id / 100) % 5 = 2", "text = 'test'"])
    assert df.count() == 200 and len({f.rsplit("/", 1)[0] for f in df.inputFiles()}) == 2
    assert scan_index(spark, t, limit=10).count() == 10 and scan_index(spark, t, limit=0).count() == 0
    assert scan_index(spark, t, start=150, end=260).count() == 110
    empty = scan_index(spark, t, ["text"], ["id < 0"])
    assert empty.count() == 0 and empty.columns == ["text"]
    with pytest.raises(ValueError):
        build_partition(t, rows(spark, 0, 10), store, "c", 5, 10)
    with pytest.raises(ValueError):
        build_partition(t, rows(spark, 0, 10).withColumn("x", F.lit(1)), store, "c", 0, 10)


def test_build_loop(spark, tmp_path):
    store = Store(spark, StorageConf("file", str(tmp_path)))
    tables = {"t": ("id", SCHEMA), "u": ("id", SCHEMA)}
    m = load_or_create(store, "c", tables, 1000)
    report = build_index(spark, m, lambda t, a, b: rows(spark, a, b), store, 9_999, end=1025)
    assert [(p.lower_bound, p.row_count, p.incomplete) for p in report.finished if p.table == "t"] == [(0, 1000, False), (1000, 25, True)]
    again = load_or_create(store, "c", tables, 5)
    assert again.blocks_per_partition == 1000 and again.resume_block() == 1000
    report = build_index(spark, again, lambda t, a, b: rows(spark, a, b), store, 2_499)
    assert [(p.lower_bound, p.row_count) for p in report.finished if p.table == "u"] == [(1000, 1000), (2000, 500)]
    with pytest.raises(ValueError):
        load_or_create(store, "other", tables, 5)


def test_build_failure(spark, tmp_path):
    store = Store(spark, StorageConf("file", str(tmp_path)))
    m = load_or_create(store, "c", {"t": ("id", SCHEMA), "bad": ("id", SCHEMA)}, 10)

    def give(table, a, b):
        if table == "bad":
            raise RuntimeError("made to fail")
        return rows(spark, a, b)

    report = build_index(spark, m, give, store, 100)
    assert len(report.finished) == 1 and len(report.failed) == 1 and "made to fail" in report.failed[0][2]
    assert store.load("index.json") is None
    assert len(build_index(spark, Manifest.from_json(Manifest("c", 10).to_json()), give, store, 5, skip=["bad"]).failed) == 0


def synthetic(head=1000):
    def fetch(numbers):
        return [{"id": hex(n), "hash": "0x" + n.to_bytes(32, "big").hex()} for n in numbers]

    c = (ColumnSpec("id", BLOCK_NUMBER, False, L.hex_to_int(F.col("id"))), ColumnSpec("hash", fixed_bytes(32), False, L.decode_hex(F.col("hash"))))
    return ChainSpec("made", {"t": EntitySpec("t", "id", c, fetch, "id string, hash string")}, lambda: head, 100)


def test_live(spark):
    chain = synthetic()
    assert [r.id for r in scan_live(spark, chain, "t", filters=["id % 100 = 7"]).collect()] == list(range(7, 1001, 100))
    assert scan_live(spark, chain, "t", last_n=10).count() == 10
    assert scan_live(spark, chain, "t", start=5, end=25, filters=["id > 10", "hash IS NOT NULL"]).count() == 14
    assert scan_live(spark, chain, "t", start=5, end=5).count() == 0
    df = scan_live(spark, chain, "t", ["id"], start=0, end=500).filter("id IN (3, 4, 900)")
    assert [r.id for r in df.collect()] == [3, 4]
    with pytest.raises(ValueError):
        scan_live(spark, chain, "t", filters=["hash IS NULL"])


def test_entities(spark):
    raw = {"number": "0xf4240", "hash": "0x" + "1" * 64, "timestamp": "0x5", "difficulty": "0x" + "f" * 20, "totalDifficulty": "0x10"}
    df = spark.createDataFrame([raw], eth_blocks().raw_schema)
    got = eth_blocks().typed(df).first()
    assert got.number == 1_000_000 and got.difficulty is None and got.total_difficulty == 16.0 and got.timestamp == datetime.datetime(1970, 1, 1, 0, 0, 5)
    log = {"blockNumber": "0x1", "blockHash": "0x" + "2" * 64, "logIndex": "0x0", "topics": ["0x" + "3" * 64], "transactionHash": "0x" + "4" * 64, "transactionIndex": "0x9", "data": "0x01"}
    got = eth_logs().typed(spark.createDataFrame([log], eth_logs().raw_schema)).first()
    assert bytes(got.data) == b"\x01" and len(got.topic1) == 32 and got.topic2 is None
    for broken in (raw | {"number": None}, raw | {"hash": "0x11"}):
        with pytest.raises(Exception, match="null in a required|expected 32"):
            eth_blocks().typed(spark.createDataFrame([broken], eth_blocks().raw_schema)).collect()
    c = ColumnSpec("a", VARCHAR, True, F.lit("x"))
    for columns, block in (((), "a"), ((c, c), "a"), ((c,), "a"), ((ColumnSpec("n", U256, False, F.lit("1")),), "n")):
        with pytest.raises(ValueError):
            EntitySpec("t", block, columns)


def test_engine(spark, tmp_path):
    store = Store(spark, StorageConf("file", str(tmp_path)))
    m = Manifest("eth", 100)
    build_range(m.new_table("t", "id", SCHEMA), rows(spark, 0, 1000), store, "eth", 0, 1000)
    c = (ColumnSpec("id", BLOCK_NUMBER, False, F.col("id")), ColumnSpec("text", VARCHAR, True, F.col("text")))
    e = Engine(spark)
    e.add_chain(ChainSpec("eth", {"t": EntitySpec("t", "id", c)}, lambda: 999, 100), m)
    e.add_chain(synthetic())
    assert e.tables() == [("eth", "t"), ("made", "t")] and e.describe("t").count() == 2
    df = e.sql("SELECT count(*) AS n FROM eth.t a WHERE a.id >= current_block('eth') - 49 AND 'eth.t' <> ''")
    assert df.first().n == 50 and len(df.inputFiles()) == 1
    assert len({f.rsplit("/", 1)[0] for f in e.sql("SELECT * FROM t WHERE floor(id / 100) IN (3, 5)").inputFiles()}) == 2
    both = e.sql("SELECT a.id FROM t a JOIN t b ON a.id = b.id + 500 WHERE a.id < 600 AND b.id % 100 = 1")
    assert [r.id for r in both.collect()] == [501]
    assert e.sql("SELECT count(*) AS n FROM t").first().n == 1000
    live = e.sql("SELECT x.id, t.text FROM made.t x JOIN t ON t.id = x.id WHERE x.id % 100 = 7 AND x.hash IS NOT NULL")
    assert sorted(r.id for r in live.collect()) == list(range(7, 1000, 100))
    with pytest.raises(ValueError):
        e.sql("SELECT * FROM made.t")
    assert {tuple(r) for r in e.sql("SHOW TABLES").collect()} == {("eth", "t"), ("made", "t")} == {tuple(r) for r in e.sql("SELECT * FROM information_schema.tables").collect()}
    assert e.sql("describe made.t").count() == 2 and e.sql("SELECT column_name FROM information_schema.columns WHERE table_schema = 'eth'").count() == 2
    assert e.sql("SELECT t.id FROM t WHERE t.id = 5 UNION ALL SELECT id FROM t LIMIT 3").count() == 3
    e.set_window(last_n=30)
    assert e.table("t").count() == 30 and e.sql("SELECT count(*) AS n FROM t").first().n == 30 and e.table("made.t").count() == 30
    with pytest.raises(LookupError):
        e.table("eth.none")
    bad = synthetic()
    bad.name, bad.head = "down", lambda: 1 / 0
    e.chains["down"] = bad
    assert "down" in e.refresh() and e.head("eth") == 999


def test_dialect(spark):
    assert translate("a SIMILAR TO 'x%' AND approx_distinct(b) > 'approx_distinct('") == "a RLIKE '^(?s:x.*)$' AND approx_count_distinct(b) > 'approx_distinct('"
    e = Engine(spark)
    got = e.sql("""SELECT strpos('abc', 'c') AS a, to_hex(255) AS b, lower(hex(sha256('x'))) AS c, hex(digest('x', 'md5')) = upper(md5('x')) AS d, starts_with('ab', 'a') AS e,
        to_timestamp_seconds(5) AS f, to_timestamp_millis(1500) AS g, date_bin(INTERVAL '15' MINUTE, TIMESTAMP_NTZ'2024-01-01 10:44:59', TIMESTAMP_NTZ'2024-01-01 00:00:00') AS h,
        'a.c' SIMILAR TO 'a.(b|c)' AS i, 'abc' NOT SIMILAR TO 'a.(b|c)' AS j, 'xyz' SIMILAR TO '_y[a-z]' AS k, arrow_typeof(1) AS l""").first()
    assert tuple(got)[:2] == (3, "ff") and got.c == hashlib.sha256(b"x").hexdigest() and got.d and got.e and got.i and got.j and got.k and got.l == "int"
    assert (got.f, got.g, got.h) == (datetime.datetime(1970, 1, 1, 0, 0, 5), datetime.datetime(1970, 1, 1, 0, 0, 1, 500000), datetime.datetime(2024, 1, 1, 10, 30))
    assert e.sql("SELECT approx_distinct(id) AS n FROM range(10)").first().n == 10


def test_storage(spark, tmp_path):
    f = StorageConf.parse({"type": "file", "dirpath": str(tmp_path)})
    s3 = StorageConf.parse({"type": "s3", "bucket": "b", "prefix": "p/"})
    mem = StorageConf.parse({"type": "memory", "bucket": "m"})
    assert f.accepts(Location(f"file://{tmp_path}/a")) and not f.accepts(Location(f"file://{tmp_path}x/a")) and not f.accepts(Location("s3a://b/p/a"))
    assert s3.accepts(Location("s3a://b/p/x")) and not s3.accepts(Location("s3a://c/p/x")) and not s3.accepts(Location("s3a://b/q"))
    assert StorageConf("ipfs").accepts(Location("ipfs://abc/d")) and s3.object_store_url() == "s3a://b" and f.object_store_url() == "file://"
    assert store_for([s3, f], Location(f"file://{tmp_path}/a")) is f
    with pytest.raises(LookupError):
        store_for([s3], Location("file:///a"))
    loc = Location.of("s3a", "b", "/x/y.parquet")
    assert (str(loc), loc.bucket, loc.path, loc.scheme) == ("s3a://b/x/y.parquet", "b", "x/y.parquet", "s3a") and Location("file:///a").bucket is None
    a, b = Store(spark, mem), Store(spark, mem)
    a.save("index.json", "one")
    a.save("index.json", "two")
    assert b.load("index.json") == "two" and b.load("none") is None
    with pytest.raises(FileNotFoundError):
        Store(spark, StorageConf("file", str(tmp_path / "missing")))
    for bad in ({"type": "tape"}, {"type": "s3"}):
        with pytest.raises(ValueError):
            StorageConf.parse(bad)


class Node(BaseHTTPRequestHandler):
    def do_POST(self):
        calls = json.loads(self.rfile.read(int(self.headers["content-length"])))
        out = []
        for c in calls:
            if c["method"] == "eth_blockNumber":
                r = hex(25)
            elif c["method"] == "eth_getBlockByNumber":
                n = int(c["params"][0], 16)
                r = {"number": hex(n), "hash": "0x" + n.to_bytes(32, "big").hex(), "transactions": []} if n < 1000 else None
            elif c["method"] == "eth_getBlockReceipts":
                n = int(c["params"][0], 16)
                log = {"blockNumber": hex(n), "blockHash": "0x" + n.to_bytes(32, "big").hex(), "logIndex": "0x0", "topics": [], "transactionHash": "0x" + "4" * 64, "transactionIndex": "0x0"}
                r = [{"logs": [log, log]}]
            elif c["method"] == "trace_block":
                r = [{"traceAddress": [0]}]
            elif c["method"] == "eth_getTransactionReceipt":
                r = {"hash": c["params"][0]}
            else:
                out.append({"id": c["id"], "error": {"code": 1, "message": "no"}})
                continue
            out.append({"id": c["id"], "result": r})
        body = json.dumps(out[::-1]).encode()
        self.send_response(200)
        self.send_header("content-length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def node():
    server = HTTPServer(("127.0.0.1", 0), Node)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_rpc(node):
    client = RpcClient(RpcConfig(node, batch_size=3))
    assert client.head() == 25 and [b["number"] for b in client.blocks(range(8))] == [hex(i) for i in range(8)]
    assert client.blocks([5000]) == [] and len(client.logs([1, 2])) == 4 and len(client.traces(0, 3)) == 3 and len(client.receipts_by_hash(["0x1"])) == 1
    with pytest.raises(RuntimeError):
        client.batch("unknown", [[]])
    with pytest.raises(ValueError):
        client.batch("eth_blockNumber", [])
    with pytest.raises(ValueError):
        RpcClient(RpcConfig())
    with pytest.raises(RuntimeError):
        RpcClient(RpcConfig("x"), lambda *_: b"{}").head()


def test_cli(spark, node, tmp_path, capsys):
    (tmp_path / "data").mkdir()
    conf = tmp_path / "c.toml"
    conf.write_text(f'[chains.eth.rpc]\nurl = "{node}"\n[stores.eth]\ntype = "file"\ndirpath = "{tmp_path}/data"\n[stores.odd]\ntype = "tape"\n')
    assert cli.main(["--config", str(conf), "config"], spark) == 0
    assert "chain eth: store eth, 10000" in capsys.readouterr().out
    assert cli.main(["--config", str(conf), "index", "--chain", "eth", "--end-block", "25", "--blocks-per-partition", "10", "--yes"], spark) == 0
    assert "logs 20 10 rows" in capsys.readouterr().out
    assert cli.main(["--config", str(conf), "sql", "--format", "jsonl", "--command", "SELECT count(*) AS n, max(number) AS m, current_block('eth') AS h FROM eth.blocks"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"n": 25, "m": 24, "h": 25}
    for form, want in (("csv", "n\n25"), ("json", '[{"n":25}]'), ("table", "25")):
        cli.main(["--config", str(conf), "sql", "--format", form, "--command", "SELECT count(*) AS n FROM blocks"], spark)
        assert want in capsys.readouterr().out
    assert cli.main(["--config", str(conf), "sql", "--last-n-blocks", "5", "--format", "csv", "--command", "SELECT count(*) AS n FROM blocks"], spark) == 0
    assert "n\n4" in capsys.readouterr().out
    assert cli.main(["--config", str(conf), "sql", "--command", "SELECT broken("], spark) == 1
    assert cli.main(["--config", str(conf), "index", "--chain", "none"], spark) == 1


def test_repl(spark, capsys):
    lines = ["SELECT 1 AS a,\n", "  2 AS b;\n", "SELECT broken(;\n", ";\n", "SELECT 3 AS c\n"]
    assert list(cli.statements(lines[:2] + ["\\q\n", "SELECT 9;"])) == ["SELECT 1 AS a,\n  2 AS b;\n"]
    assert cli.repl(Engine(spark), lines, "jsonl") == 1
    out = capsys.readouterr()
    assert out.out.split() == ['{"a":1,"b":2}', '{"c":3}'] and "error" in out.err


def test_names(spark):
    known = {("blocks",): "v_b", ("logs",): "v_l", ("eth", "blocks"): "v_b", ("main", "eth", "logs"): "v_l"}

    def of(text):
        return replaced(spark, text, lambda p: known.get(tuple(p)))

    assert of("WITH blocks AS (SELECT 1 AS x) SELECT * FROM blocks") == ("WITH blocks AS (SELECT 1 AS x) SELECT * FROM blocks", [])
    assert of("SELECT 'é𝄞 FROM blocks' FROM blocks -- blocks")[0] == "SELECT 'é𝄞 FROM blocks' FROM (v_b AS `blocks`) -- blocks"
    assert of("SELECT eth.blocks.*, eth.blocks.x FROM eth.blocks, main.eth.logs l")[0] == "SELECT `blocks`.*, `blocks`.`x` FROM (v_b AS `blocks`), (v_l AS `logs`) l"
    assert of("SELECT 1 WHERE EXISTS (SELECT 1 FROM logs) AND 2 IN (SELECT x FROM blocks)")[1] == ["v_l", "v_b"] or of("SELECT 1 WHERE EXISTS (SELECT 1 FROM logs) AND 2 IN (SELECT x FROM blocks)")[1] == ["v_b", "v_l"]
    assert of("TABLE blocks")[0] == "TABLE v_b"


def test_sql_forms(spark, tmp_path):
    store = Store(spark, StorageConf("file", str(tmp_path)))
    m = Manifest("eth", 100)
    build_range(m.new_table("t", "id", SCHEMA), rows(spark, 0, 1000), store, "eth", 0, 1000)
    e = Engine(spark)
    c = (ColumnSpec("id", BLOCK_NUMBER, False, F.col("id")), ColumnSpec("text", VARCHAR, True, F.col("text")))
    e.add_chain(ChainSpec("eth", {"t": EntitySpec("t", "id", c)}, lambda: 999, 100), m)
    e.add_chain(synthetic())
    assert e.sql("WITH t AS (SELECT 1 AS x) SELECT count(*) AS n FROM t").first().n == 1
    assert e.sql("WITH t AS (SELECT id FROM t WHERE id < 7) SELECT count(*) AS n FROM t").first().n == 7
    assert e.sql("SELECT count(*) AS n FROM t a, t b WHERE a.id = b.id + 990").first().n == 10
    df = e.sql("SELECT id FROM t WHERE id >= ? AND id < ?", [150, 180])
    assert df.count() == 30 and len(df.inputFiles()) == 1
    assert "GreaterThanOrEqual(id,950)" in e.sql("EXPLAIN FORMATTED SELECT * FROM t WHERE id >= 950").first().plan
    # a table without an index and without a condition can be explained, but not read
    assert "Physical Plan" in e.sql("EXPLAIN SELECT * FROM made.t").first().plan
    # files that lie in none of the configured stores are refused
    e.add_store(StorageConf("file", str(tmp_path)))
    assert e.sql("SELECT count(*) AS n FROM t").first().n == 1000
    other = Engine(spark)
    other.add_chain(e.chains["eth"], m)
    (tmp_path / "else").mkdir()
    other.add_store(StorageConf("file", str(tmp_path / "else")))
    with pytest.raises(LookupError):
        other.sql("SELECT * FROM t").count()


def test_resume_and_repeat(spark, tmp_path):
    store = Store(spark, StorageConf("memory", bucket="resume"))
    tables = {"t": ("id", SCHEMA), "u": ("id", SCHEMA)}
    m = load_or_create(store, "c", tables, 100)
    done = []
    build_index(spark, m, lambda t, a, b: rows(spark, a, b), store, 449, skip=["u"], stride=3, progress=lambda p, d, n: done.append((len(p), d, n)))
    assert done == [(3, 300, 450), (2, 450, 450)]
    again = load_or_create(store, "c", tables, 100)
    assert again.resume_block() == 400 and again.table("u").last() is None
    report = build_index(spark, again, lambda t, a, b: rows(spark, a, b), store, 499, skip=["u"])
    assert [(p.lower_bound, p.row_count, p.incomplete) for p in report.finished] == [(400, 100, False)]
    # a build that is repeated with fewer rows leaves no row of the first
    index = again.table("t")
    for keep in ("true", "id >= 250"):
        build_range(index, rows(spark, 0, 500).filter(keep), store, "c", 0, 500)
    assert scan_index(spark, index, readable=store.readable).count() == 250 and index.ids() == [200, 300, 400]
    build_range(index, rows(spark, 0, 0), store, "c", 0, 500)
    assert index.ids() == [400] and index.next_block() == 500 and scan_index(spark, index).count() == 0
    with pytest.raises(ValueError):
        build_range(index, rows(spark, 0, 10).withColumn("x", F.lit(1)), store, "c", 0, 100)


def test_upserted_is_add_after_add(spark):
    entries = [("t", 100 * (i * 7 % 5), i, i % 3, f"f{i}") for i in range(40)]
    df = spark.createDataFrame(entries, "table_name string, lower_bound bigint, entry bigint, x bigint, location string")
    t = index()
    for _, low, i, _, loc in entries:
        t.add(BlockPartition("t", low, loc, WHEN, i, i))
    assert {(r.lower_bound, r.location) for r in upserted(df, ["entry"], 100).collect()} == {(p.lower_bound, p.location) for p in t.ordered()}
    with pytest.raises(Exception, match="no multiple"):
        upserted(df, ["entry"], 70).collect()


def test_location_parts(spark):
    urls = ["file:///a/b.parquet", "s3a://bkt/p/q.parquet", "ipfs://abc", "S3A://b//x", "hdfs://n:9000/y?z#w"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", *[c.alias(n) for c, n in zip(location_parts(F.col("u")), ("s", "b", "p"), strict=True)]).collect()
    assert [(r.s, r.b, r.p) for r in got] == [(Location(u).scheme, Location(u).bucket, Location(u).path) for u in urls]


def test_config(monkeypatch, tmp_path):
    monkeypatch.setenv("ETH_RPC_API", "http://x")
    c = Config.load(str(tmp_path / "none.toml"))
    assert c.rpc_url("eth") == "http://x" and c.blocks_per_partition("polygon") == 100_000 and c.store_name("eth") == "eth"
    assert Config.parse('[chains.eth]\nuse_conf = "s"\n[chains.eth.rpc]\nurl = "y"').rpc_url("eth") == "y"


def test_assets(spark, tmp_path):
    for name, text in (("0xa", '{"name": "A", "links": []}'), ("0xb", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "info.json").write_text(text)
    assert [(r.address, r.name) for r in read_assets(spark, f"{tmp_path}/*/info.json").collect()] == [("0xa", "A")]


def test_load_chain(spark, tmp_path):
    for name, text in (("c", '{"name": "C"}'), ("c/assets/0xa", '{"name": "A"}'), ("d", '{"name": "D"}')):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "info.json").write_text(text)
    info, assets = load_chain(spark, str(tmp_path), "c")
    assert info == {"name": "C"} and [r.address for r in assets.collect()] == ["0xa"]
    info, none = load_chain(spark, str(tmp_path), "d")
    assert none.count() == 0 and set(none.columns) == set(assets.columns)
    with pytest.raises(FileNotFoundError):
        load_chain(spark, str(tmp_path), "missing")


def test_batch_rows():
    assert len(list(batch_rows([(1,)] * 50, 10))) == 10 and list(batch_rows([(1,)], 0)) == [] and len(list(batch_rows([(1,)] * 3, None))) == 3


def test_follow(spark, tmp_path):
    from blockloom.streaming.follow import follow

    q = follow(spark, synthetic(head=249), "t", start=100, blocks_per_step=60).select("id").writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(4):
            q.processAllAvailable()
        assert sorted(r.id for r in spark.table("followed").collect()) == list(range(100, 250))
    finally:
        q.stop()
