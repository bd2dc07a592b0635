"""Processing only new or changed records, once each, across failed runs.

A listing of the current files is anti-joined with the manifest of what has been
processed, by key and checksum. What remains is written under its batch identifier
and only then recorded in the manifest; a run that dies in between writes the same
batch again to the same place.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.session import hadoop, move


def checksum(columns: Sequence[str]) -> Column:
    """SHA-256 over the named columns; null equals null and differs from any value."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])), 256)


def newest(entries: DataFrame, key: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The last entry of each key by `order`, as key + payload; one partial aggregation, no sort.

    Entries that tie in `order` are told apart by their payload, so the result is
    the same on each run.
    """
    state = F.struct(*order, *[c for c in payload if c not in order])
    return entries.groupBy(*key).agg(F.max(state).alias("_last")).select(*key, *[F.col(f"_last.{c}").alias(c) for c in dict.fromkeys([*order, *payload])])


def last_success(runs: DataFrame, job: str = "index") -> DataFrame:
    """Greatest snapshot of a succeeded run of `job` per table: table_name, snapshot."""
    return runs.filter((F.col("job") == job) & (F.col("status") == "succeeded")).groupBy("table_name").agg(F.max("snapshot_at").alias("snapshot"))


def listing(entries: DataFrame, key: Sequence[str], compared: Sequence[str], at: str = "recorded_at", tie: str = "entry_id") -> DataFrame:
    """The newest entry of each key, as key, at, tie, compared and their checksum."""
    return newest(entries, key, [at, tie], compared).withColumn("checksum", checksum(compared))


def seen(entries: DataFrame, snapshots: DataFrame, at: str = "recorded_at") -> tuple[DataFrame, DataFrame]:
    """(entries that the run of each table's snapshot has seen, the others).

    A table without a snapshot has seen nothing. An entry whose `at` is null cannot be
    placed in time; it counts as seen, also in a table without a snapshot.
    """
    # a row per table of the ledger, small by nature
    marked = entries.join(snapshots.select(F.col("table_name").alias("_t"), "snapshot"), F.col("table_name") == F.col("_t"), "left").drop("_t")
    old = F.coalesce(F.col(at) <= F.col("snapshot"), F.col(at).isNull())
    return marked.filter(old).drop("snapshot"), marked.filter(~old).drop("snapshot")


class Ledger:
    """A manifest of finished batches in a folder: `batches/<id>` and `commits/<number>-<id>.json`.

    Only committed batches count; their numbers give their order, whatever their names.
    `run` is safe to repeat with the same batch id. One writer at a time.
    """

    def __init__(self, spark, base: str):
        self.spark, self.base = spark, base
        self._fs, _ = hadoop(spark, base)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def committed(self) -> list[str]:
        """Identifiers of the committed batches, in the order of their commits."""
        folder = self._path(f"{self.base}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return [n.partition("-")[2].removesuffix(".json") for n in sorted(n for n in names if n.endswith(".json") and not n.startswith("."))]

    def manifest(self, schema, batches: Sequence[str] | None = None) -> DataFrame:
        """Rows of all committed batches, or of some of them; an uncommitted folder is not read."""
        ids = [i for i in self.committed() if batches is None or i in batches]
        return self.spark.read.schema(schema).parquet(*[f"{self.base}/batches/{i}" for i in ids]) if ids else self.spark.createDataFrame([], schema)

    def pending(self, listed: DataFrame, key: Sequence[str], check: str = "checksum", order: Sequence[str] = ()) -> DataFrame:
        """Rows of the listing whose (key, checksum) is not the newest processed one.

        Of repeated keys in a listing the last by `order`, then by checksum, is kept.
        """
        first = dict.fromkeys([*order, check])
        rest = [c for c in listed.columns if c not in first and c not in key]
        one = listed.groupBy(*key).agg(F.max(F.struct(*first, *rest)).alias("_r")).select(*key, "_r.*")
        cols = [*key, check]
        done = self.manifest(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema.fields if f.name in cols) + ", batch_no bigint")
        latest = done.groupBy(*key).agg(F.max_by(check, "batch_no").alias(check))
        on = [one[k].eqNullSafe(latest[k]) for k in cols]
        return one.join(latest, on, "left_anti")

    def run(self, batch: str, listed: DataFrame, key: Sequence[str], check: str = "checksum", order: Sequence[str] = (), fail: str = "") -> int:
        """Process what is pending as batch `batch`; returns its rows, 0 if it was committed before.

        The rows are written with the batch's id and number, over what a failed attempt
        of the same batch left, and only then is the batch committed.
        fail: `write` or `commit` stops just after that step, for tests of recovery.
        """
        done = self.committed()
        if batch in done:
            return 0
        out, number = f"{self.base}/batches/{batch}", len(done)
        self.pending(listed, key, check, order).withColumn("batch", F.lit(batch)).withColumn("batch_no", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(out)
        rows = self.spark.read.parquet(out).count()
        if fail == "write":
            raise RuntimeError("stopped before the commit")
        name = f"{number:012d}-{batch}.json"
        staged, final = f"{self.base}/commits/.{name}.tmp", f"{self.base}/commits/{name}"
        stream = self._fs.create(self._path(staged), True)
        stream.write(bytearray(json.dumps({"batch": batch, "rows": rows}).encode()))
        stream.close()
        move(self.spark, staged, final)
        if fail == "commit":
            raise RuntimeError("stopped after the commit")
        return rows


def process_changes(ledger: Ledger, batch: str, entries: DataFrame, snapshots: DataFrame, key: Sequence[str], compared: Sequence[str], at: str = "recorded_at", tie: str = "entry_id") -> DataFrame:
    """Run batch `batch` over what is new or changed since the snapshots, and return its rows: key, at, tie, compared, checksum.

    If the ledger is new, what the runs of the snapshots have seen becomes its first
    batch, `seen`. The listing is every key whose newest entry no run has seen; it is
    anti-joined with the ledger by key and checksum, written, and committed. A key whose
    newest entry equals the one last seen is not processed again.
    """
    picked = entries.select(*dict.fromkeys([*key, "table_name", at, tie, *compared]))
    old, _ = seen(picked, snapshots, at)
    if not ledger.committed():
        ledger.run("seen", listing(old, key, compared, at, tie), key)
    _, fresh = seen(listing(picked, key, compared, at, tie), snapshots, at)
    ledger.run(batch, fresh, key, order=[at, tie])
    return ledger.manifest(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema.fields), [batch])


def file_listing(spark, folder: str) -> DataFrame:
    """location, byte_count and checksum (SHA-256) of each file below a folder, on any file system that Spark and Arrow both know.

    Contents are streamed by the executors, so a file may have any size. Files of no
    bytes hold no records and are not listed.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as files

        for batch in batches:
            sums = []
            for where in batch.column(0).to_pylist():
                local = where.removeprefix("file:") if where.startswith("file:") else where
                fs, path = files.FileSystem.from_uri("file:///" + quote(local.lstrip("/")) if local.startswith("/") else local)
                digest = hashlib.sha256()
                with fs.open_input_stream(path) as stream:
                    while chunk := stream.read(1 << 22):
                        digest.update(chunk)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=["location", "byte_count", "checksum"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.col("path").alias("location"), F.col("length").alias("byte_count")).mapInArrow(hashed, "location string, byte_count bigint, checksum string")
