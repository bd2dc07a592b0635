import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from blockloom.engine import Engine
from blockloom.operators.builder import build_index, load_or_create
from blockloom.sources.ipfs import IpfsStore
from blockloom.sources.manifest import Manifest
from blockloom.sources.storage import StorageConf, open_store
from blockloom.spec import BLOCK_NUMBER, VARCHAR, ChainSpec, ColumnSpec, EntitySpec


class Node(BaseHTTPRequestHandler):
    files = {"/ipfs/abc": b"0123456789", "/ipns/named": b"by name"}

    def answer(self, status, body=b"", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("content-length", str(len(body)))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    def do_GET(self):
        body = self.files.get(self.path)
        if body is None:
            return self.answer(404)
        if self.headers.get("range"):
            a, b = self.headers["range"].removeprefix("bytes=").split("-")
            return self.answer(206, body[int(a) : int(b) + 1])
        return self.answer(200, body, x_ipfs_roots="root,leaf")

    do_HEAD = do_GET

    def do_POST(self):
        body = self.rfile.read(int(self.headers.get("content-length") or 0))
        name = self.path.split("?")[0].removeprefix("/api/v0/")
        if name == "add":
            self.files["/ipfs/new"] = body.split(b"\r\n\r\n", 1)[1].rsplit(b"\r\n--", 1)[0]
            return self.answer(200, json.dumps({"Hash": "new"}).encode() + b"\n")
        return self.answer(200, json.dumps({"key/list": {"Keys": [{"Name": "k", "Id": "id1"}]}, "key/gen": {"Id": "id2"}, "name/publish": {"Name": "id1"}}[name]).encode())

    def log_message(self, *_):
        pass


def test_ipfs():
    server = HTTPServer(("127.0.0.1", 0), Node)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    store = IpfsStore(url, url, "k")
    assert store.get("abc") == b"0123456789" and store.get("named") == b"by name" and store.size("abc") == 10
    assert store.get_range("abc", 2, 5) == b"234" and store.get_range("abc", 5, 5) == b""
    with pytest.raises(FileNotFoundError):
        store.get("none")
    assert store.get(store.add("a/b", b"content")) == b"content"
    assert store.resolve("named") == "leaf" and store.resolve("none") is None
    assert store.keys() == {"k": "id1"} and store.create_key("x") == "id2" and store.publish("new") == "id1"
    assert [IpfsStore(url).mode, IpfsStore(url, url).mode, store.mode] == ["read", "add", "publish"]
    for bad in (lambda: IpfsStore(url).add("a", b""), lambda: IpfsStore(url, url, "other").publish("new")):
        with pytest.raises(ValueError):
            bad()
    server.shutdown()


class Whole(BaseHTTPRequestHandler):
    """A node that keeps what is added, and what is published under its key."""

    files: dict = {}
    names: dict = {}

    def say(self, status, body=b"", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("content-length", str(len(body)))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    def do_GET(self):
        space, _, name = self.path.lstrip("/").partition("/")
        address = self.names.get(name) if space == "ipns" else name
        body = self.files.get(address)
        self.say(404) if body is None else self.say(200, body, x_ipfs_roots=address)

    do_HEAD = do_GET

    def do_POST(self):
        body = self.rfile.read(int(self.headers.get("content-length") or 0))
        call, _, args = self.path.partition("?")
        if call.endswith("/add"):
            content = body.split(b"\r\n\r\n", 1)[1].rsplit(b"\r\n--", 1)[0]
            address = f"q{len(self.files)}"
            self.files[address] = content
            return self.say(200, json.dumps({"Hash": address}).encode())
        if call.endswith("/key/list"):
            return self.say(200, json.dumps({"Keys": [{"Name": "mine", "Id": "id1"}]}).encode())
        self.names["id1"] = args.split("%2Fipfs%2F")[1].split("&")[0]
        return self.say(200, json.dumps({"Name": "id1"}).encode())

    def log_message(self, *_):
        pass


def test_index_on_a_node(spark):
    """An index is built on a node, published, loaded by its key, and queried."""
    server = HTTPServer(("127.0.0.1", 0), Whole)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    conf = StorageConf.parse({"type": "ipfs", "gateway": url, "rpc": url, "key": "mine"})
    store = open_store(spark, conf)
    assert store.load("index.json") is None
    c = (ColumnSpec("id", BLOCK_NUMBER, False, F.col("id")), ColumnSpec("text", VARCHAR, True, F.col("text")))
    entity = EntitySpec("t", "id", c)
    manifest = load_or_create(store, "eth", {"t": ("id", entity.schema)}, 10)
    report = build_index(spark, manifest, lambda t, a, b: spark.range(a, b).select("id", F.lit("x").alias("text")), store, 24, stride=2)
    assert [(p.lower_bound, p.row_count, p.incomplete) for p in report.finished] == [(0, 10, False), (10, 10, False), (20, 5, True)]
    engine = Engine(spark)
    engine.add_store(conf)
    engine.add_chain(ChainSpec("eth", {"t": entity}, lambda: 24, 10), Manifest.from_json(engine.store(conf).load("index.json")))
    assert engine.sql("SELECT count(*) AS n FROM t WHERE id % 10 < 2 AND id >= 10").first().n == 4
    assert len(engine.files("t", ["id >= 10"])) == 2 and engine.files("t")[0].startswith("ipfs://")
    with pytest.raises(ValueError):
        open_store(spark, StorageConf("ipfs"))
    server.shutdown()
