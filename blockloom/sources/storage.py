"""Where partition files and manifests live: configurations, locations and small files."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockloom.session import hadoop, move, scratch_path
from blockloom.sources.ipfs import IpfsStore


@dataclass(frozen=True)
class Location:
    """A file's URL: scheme://bucket/path."""

    url: str

    @staticmethod
    def of(scheme: str, bucket: str | None, path: str) -> Location:
        return Location(f"{scheme}://{bucket or ''}/{path.lstrip('/')}")

    @property
    def scheme(self) -> str:
        return urlsplit(self.url).scheme

    @property
    def bucket(self) -> str | None:
        return urlsplit(self.url).netloc or None

    @property
    def path(self) -> str:
        """The path below the root, without a leading slash."""
        return urlsplit(self.url).path.lstrip("/")

    def __str__(self) -> str:
        return self.url


def location_parts(url: Column) -> tuple[Column, Column, Column]:
    """Scheme, bucket (null without one) and path of a column of URLs, as `Location` tells them."""
    bucket = F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1)
    path = F.regexp_extract(url, "^[^:/?#]+:(?://[^/?#]*)?/*([^?#]*)", 1)
    return F.lower(F.regexp_extract(url, "^([^:/?#]+):", 1)), F.when(bucket != "", bucket), path


@dataclass(frozen=True)
class StorageConf:
    """One store. kind: file, s3, memory, ipfs or hadoop.

    file: `dirpath`. s3: `bucket` and perhaps `prefix`. memory: a scratch folder of the
    session, named by `bucket`; every store of one name shares it. ipfs: a `gateway`
    to fetch from, an `rpc` URL to add to, a `key` to publish the manifest under.
    hadoop: `dirpath` is any URL that Hadoop has a file system for. options: Hadoop
    settings of the store, such as `fs.s3a.access.key`; without them the usual
    environment variables hold.
    """

    kind: str
    dirpath: str | None = None
    bucket: str | None = None
    prefix: str | None = None
    filename: str = "index.json"
    gateway: str | None = None
    rpc: str | None = None
    key: str | None = None
    options: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self) -> None:
        if self.kind not in ("file", "s3", "memory", "ipfs", "hadoop"):
            raise ValueError(f"unknown store type {self.kind!r}")
        if self.kind in ("s3", "memory") and not self.bucket:
            raise ValueError(f"a {self.kind} store needs a bucket")
        if self.kind == "hadoop" and not urlsplit(self.dirpath or "").scheme:
            raise ValueError("a hadoop store needs a URL")

    @staticmethod
    def parse(conf: dict) -> StorageConf:
        """From a mapping with a `type`."""
        known = {k: conf[k] for k in ("dirpath", "bucket", "prefix", "filename", "gateway", "rpc", "key") if k in conf}
        options = tuple(sorted((str(k), str(v)) for k, v in dict(conf.get("options", {})).items()))
        return StorageConf(kind=str(conf.get("type", "")).lower(), options=options, **known)

    @property
    def scheme(self) -> str:
        return urlsplit(self.dirpath).scheme if self.kind == "hadoop" else {"file": "file", "s3": "s3a", "memory": "memory", "ipfs": "ipfs"}[self.kind]

    @property
    def base(self) -> str:
        """The URL below which everything is stored."""
        if self.kind == "file":
            return f"file://{os.path.realpath(os.path.expanduser(self.dirpath or '~/.blockloom'))}"
        if self.kind == "memory":
            return f"memory://{self.bucket}"
        if self.kind == "hadoop":
            return self.dirpath.rstrip("/")
        if self.kind == "s3":
            return f"s3a://{self.bucket}" + (f"/{self.prefix.strip('/')}" if self.prefix else "")
        return "ipfs:/"

    def object_store_url(self) -> str:
        """scheme://bucket, the bucket only where the store has one."""
        return f"{self.scheme}://{self.bucket if self.kind in ('s3', 'memory') else ''}"

    def accepts(self, where: Location) -> bool:
        """Whether a location lies in this store: same scheme and bucket, and below its path."""
        if self.kind == "ipfs":
            return where.scheme == "ipfs"
        if self.kind == "memory":
            return any(where.url.startswith(f"{folder}/") for (_, name), folder in _MEMORY.items() if name == self.bucket)
        own = urlsplit(self.base)
        return where.scheme == own.scheme and (where.bucket or "") == own.netloc and f"/{where.path}/".startswith(own.path.rstrip("/") + "/")


#: Folders of memory stores, by session and name.
_MEMORY: dict[tuple[str, str], str] = {}


def open_store(spark, conf: StorageConf) -> Store | PublishedStore:
    """The store of a configuration."""
    return PublishedStore(spark, conf) if conf.kind == "ipfs" else Store(spark, conf)


class Store:
    """Reads and writes small files of one store through Hadoop's file systems."""

    def __init__(self, spark, conf: StorageConf):
        self.conf, self.base, self._spark = conf, conf.base, spark
        if conf.kind == "ipfs":
            raise ValueError("open an ipfs store with open_store")
        if conf.kind == "file" and not os.path.isdir(self.base.removeprefix("file://")):
            raise FileNotFoundError(self.base)
        if conf.kind == "memory":
            self.base = _MEMORY.setdefault((spark.sparkContext.applicationId, conf.bucket), scratch_path(spark, "memory"))
        for name, value in conf.options:
            spark.sparkContext._jsc.hadoopConfiguration().set(name, value)
        self._fs, path = hadoop(spark, self.base)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        if conf.kind in ("memory", "hadoop"):
            self._fs.mkdirs(path)

    def url(self, name: str) -> str:
        return f"{self.base}/{name}"

    def load(self, name: str) -> str | None:
        """A file's text; None if it is missing."""
        path = self._path(self.url(name))
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(self._spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def save(self, name: str, text: str) -> Location:
        """Write a file as a whole: readers see the old text or the new, never neither."""
        # an object store shows an object when it is complete; elsewhere a rename replaces in one step
        whole = self.conf.kind == "s3"
        staged, final = self._path(self.url(f".{name}.{uuid.uuid4().hex}")), self._path(self.url(name))
        self._fs.mkdirs(final.getParent())
        stream = self._fs.create(final if whole else staged, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not whole:
            move(self._spark, staged.toString(), final.toString(), replace=True)
        return Location(self.url(name))

    def readable(self, url: str) -> str:
        """Where Spark can read a location of this store."""
        return url

    def write_partition(self, rows, name: str) -> str:
        """Write rows, which their caller has put into one partition, as one file or folder; returns its location."""
        rows.write.mode("overwrite").parquet(self.url(name))
        return self.url(name)

    def size(self, url: str) -> int:
        """Bytes of a file or of all files below a folder."""
        return int(self._fs.getContentSummary(self._path(url)).getLength())

    def exists(self, url: str) -> bool:
        return bool(self._fs.exists(self._path(url)))


class PublishedStore:
    """An index on an IPFS node: files are added by content, the manifest is published under the store's key.

    Spark has no file system for it, so a partition is written to the session's scratch
    folder and added from there, and fetched back into it, once, when it is read.
    """

    def __init__(self, spark, conf: StorageConf):
        if not conf.gateway:
            raise ValueError("an ipfs store needs a gateway")
        self.conf, self.base, self._spark = conf, conf.base, spark
        self.node = IpfsStore(conf.gateway, conf.rpc, conf.key)
        self._fetched: dict[str, str] = {}
        self._sizes: dict[str, int] = {}

    def url(self, name: str) -> str:
        return f"ipfs://{name}"

    def load(self, name: str) -> str | None:
        """The manifest behind the key's name; None if nothing was published."""
        if not self.node.key:
            raise ValueError("an index on a node needs a key, under which it is published")
        known = self.node.keys().get(self.node.key, self.node.key) if self.node.rpc else self.node.key
        found = self.node.resolve(known)
        return self.node.get(found).decode() if found else None

    def save(self, name: str, text: str) -> Location:
        address = self.node.add(name, text.encode())
        self.node.publish(address)
        return Location(self.url(address))

    def write_partition(self, rows, name: str) -> str:
        out = scratch_path(self._spark, "add")
        rows.write.parquet(out)
        fs, path = hadoop(self._spark, out)
        files = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet")]
        if len(files) != 1:
            raise ValueError(f"{name}: a partition must be one file, not {len(files)}")
        stream = fs.open(files[0])
        try:
            content = bytes(self._spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        where = self.url(self.node.add(name, content))
        self._sizes[where] = len(content)
        return where

    def size(self, url: str) -> int:
        return self._sizes.get(url) or self.node.size(url.removeprefix("ipfs://"))

    def exists(self, url: str) -> bool:
        try:
            return self.node.size(url.removeprefix("ipfs://")) >= 0
        except FileNotFoundError:
            return False

    def readable(self, url: str) -> str:
        """A copy of the file in the scratch folder."""
        if url not in self._fetched:
            out = scratch_path(self._spark, "fetched") + ".parquet"
            fs, path = hadoop(self._spark, out)
            stream = fs.create(path, True)
            stream.write(bytearray(self.node.get(url.removeprefix("ipfs://"))))
            stream.close()
            self._fetched[url] = out
        return self._fetched[url]


def store_for(stores: list[StorageConf], where: Location) -> StorageConf:
    """The first store that accepts a location; an error if none does."""
    for s in stores:
        if s.accepts(where):
            return s
    raise LookupError(f"no configured store holds {where}")
