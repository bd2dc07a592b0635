"""Far too many small files: a plan over a manifest, and the rewrite of a folder.

`plan_merges` decides from a manifest which live files go into which output file.
`compact_folder` lets the engine pack the splits of real files into read tasks of
the wanted size and writes each task as one file, then verifies the staged output.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.operators.changes import newest
from blockloom.session import hadoop, move, scratch_path


#: What opening a file counts for when splits are packed, in bytes. The reader's usual
#: 4 MiB would fill a 128 MiB task with 32 tiny files; this lets it take up to 8192.
OPEN_COST = 16 << 10


def file_size(bytes_per_row: int = 200) -> Column:
    """Size by byte_count, else estimated from row_count, else null."""
    return F.coalesce("byte_count", F.lit(bytes_per_row) * F.col("row_count"))


def plan_merges(entries: DataFrame, small: int = 1_000_000, target: int = 128 << 20, open_cost: int = OPEN_COST, stretch: int = 50_000) -> DataFrame:
    """Small live files and the output file each goes to: `table_name, lower_bound,
    entry_id, location, size, row_count, bin, target_location`.

    Live is the newest entry of a key, by recorded_at and then entry_id. Incomplete
    files (null counts as complete), files of unknown size and files of `small`
    bytes or more stay as they are. Files are taken in order of lower_bound and cost
    their size plus `open_cost`, as in the engine's own split packing; a file goes
    to the bin in which its running cost starts, so a bin holds at most `target`
    plus one file and each file is in exactly one bin. The running sums are built
    from the sums of stretches of `stretch` block numbers, so a table holding most
    of the files is still summed in parallel. Null keys form a table of their own.
    """
    live = newest(entries, ["table_name", "lower_bound"], ["recorded_at", "entry_id"], ["location", "byte_count", "row_count", "incomplete"])
    files = (
        live.withColumn("size", file_size())
        .filter(~F.coalesce("incomplete", F.lit(False)) & (F.col("size") < small))
        .withColumn("_stretch", F.floor(F.coalesce("lower_bound", F.lit(-1)) / stretch))
        .withColumn("_cost", F.col("size") + open_cost)
    )
    inside = W.partitionBy("table_name", "_stretch").orderBy("lower_bound", "entry_id")
    files = files.withColumn("_within", F.sum("_cost").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    # one row per stretch: thousands of files each, so this second sum is small
    sums = files.groupBy("table_name", "_stretch").agg(F.sum("_cost").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy("table_name").orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    joined = files.alias("f").join(sums.alias("s"), F.col("f.table_name").eqNullSafe(F.col("s.table_name")) & (F.col("f._stretch") == F.col("s._stretch")))
    start = F.col("_before") + F.coalesce("_within", F.lit(0))
    return joined.select(
        "f.table_name", "f.lower_bound", "f.entry_id", "f.location", "f.size", "f.row_count", F.floor(start / target).cast("bigint").alias("bin")
    ).withColumn("target_location", F.format_string("compacted/%s/%08d.parquet", F.coalesce("table_name", F.lit("_")), "bin"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> tuple[int, int]:
    """Row count and an order-free checksum over the named columns, in one pass."""
    row = df.select(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if df.schema[c].dataType.typeName() == "map" else F.col(f"`{c}`") for c in columns]).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("x")
    ).first()
    return int(row.n), int(row.x)


@dataclass(frozen=True)
class Rewrite:
    """What a compaction did: files and bytes before and after, rows and their checksum."""

    files_before: int
    files_after: int
    bytes_before: int
    bytes_after: int
    rows: int
    checksum: int


def _data_files(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Number and bytes of the data files below a folder, or of one file."""
    fs, path = hadoop(spark, folder)
    n = size = 0
    found = fs.listFiles(path, True)
    while found.hasNext():
        f = found.next()
        # as the reader does, all but names that start with _ or .
        if not f.getPath().getName().startswith(("_", ".")):
            n, size = n + 1, size + int(f.getLen())
    return n, size


def compact_folder(spark: SparkSession, source: str, target_bytes: int = 128 << 20, open_cost: int = OPEN_COST, out: str | None = None) -> tuple[DataFrame, Rewrite]:
    """Rewrite a parquet folder into fewer files; the rewritten table, and what was done.

    The engine's split packing does the work: with the maximum partition size at
    `target_bytes` and the file-open cost at `open_cost`, the reader combines small
    files into tasks. The opening costs make them somewhat smaller than wanted, so they
    are coalesced, without a shuffle, to as many tasks as the bytes need, each of which
    writes one file. The output is staged, its row count and checksum are compared with
    the source's, and only then it is renamed to `out` (default: a path in the shared
    folder), which must not exist. A mismatch removes the staged files and raises. An
    empty folder of files gives an empty table.
    """
    out = out or scratch_path(spark, "compacted")
    fs, final = hadoop(spark, out)
    if fs.exists(final):
        raise FileExistsError(out)
    staged = f"{out}.staged"
    files, size = _data_files(spark, source)
    settings = {"spark.sql.files.maxPartitionBytes": str(target_bytes), "spark.sql.files.openCostInBytes": str(open_cost), "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.read.parquet(source)
        rows.coalesce(max(1, -(-size // target_bytes))).write.mode("overwrite").parquet(staged)
        was = fingerprint(rows, rows.columns)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if was != fingerprint(spark.read.schema(rows.schema).parquet(staged), rows.columns):
        fs.delete(hadoop(spark, staged)[1], True)
        raise RuntimeError(f"{source}: the rewritten files differ from it; nothing was replaced")
    move(spark, staged, out)
    return spark.read.schema(rows.schema).parquet(out), Rewrite(files, _data_files(spark, out)[0], size, _data_files(spark, out)[1], *was)
