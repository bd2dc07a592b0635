"""Session helpers: table access, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = 8, memory: str = "8g", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("blockloom")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table `name` below `base` (one file or a folder of files)."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`.

    Only a local session that names none (tests, a laptop) gets a temporary folder,
    which is set as the checkpoint folder and removed at exit; on a cluster it is an
    error, as its executors would not share such a folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="blockloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


_ROOTS: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this session's own part of the shared folder, which the JVM removes when it ends, on any file system."""
    key = spark.sparkContext.applicationId
    if key not in _ROOTS:
        root = f"{shared_dir(spark).rstrip('/')}/blockloom-{key}-{uuid.uuid4().hex}"
        fs, path = hadoop(spark, root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ROOTS[key] = root
    return f"{_ROOTS[key]}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut lineage: write `df` as parquet to the shared folder and read it back.

    The copy outlives a lost executor and is columnar, so later reads prune it. The
    plan runs once; a checkpoint would run it twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """`written`, for small intermediate tables."""
    return written(df)


def hadoop(spark: SparkSession, url: str) -> tuple:
    """The Hadoop file system of a URL, and its path there."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(url)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()), path


def move(spark: SparkSession, source: str, target: str, replace: bool = False) -> None:
    """Rename a file or folder; a target that exists is an error, or replaced in one step where the file system can.

    A rename that did not happen is an error.
    """
    sc = spark.sparkContext
    fs = sc._jvm.org.apache.hadoop.fs
    how = getattr(fs, "Options$Rename")
    options = sc._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE if replace else how.NONE
    context = fs.FileContext.getFileContext(fs.Path(target).toUri(), sc._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(fs.Path(source)), context.makeQualified(fs.Path(target)), options)


def few(df: DataFrame, most: int) -> list:
    """All rows of a table that must be small; more than `most` are an error, never a silent cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def local_path(uri: str) -> str:
    """The file system path of a `file:` URI or a plain path."""
    return os.path.normpath(uri.removeprefix("file://").removeprefix("file:"))
