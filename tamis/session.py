"""Session defaults and tables written to shared storage to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SPLIT_BYTES = 128 << 20  # spark.sql.files.maxPartitionBytes, by default

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_FOLDERS: dict[str, str] = {}  # by application
_CLEANING: dict[str, tuple[int, str | None]] = {}  # by session: open blocks, the setting before
_LOCK = threading.Lock()
_INNER: ContextVar[str | None] = ContextVar("inner work folder", default=None)


def get_spark(app: str = "tamis", **conf: object) -> SparkSession:
    """Session with the settings the operators rely on; existing ones are kept."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as the cluster names it.

    Only a local session without the setting gets a folder of its own.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _FOLDERS[app] = f"{(named or tempfile.mkdtemp()).rstrip('/')}/tamis-{app}"
        path, files = hadoop_path(spark, _FOLDERS[app])
        files.deleteOnExit(path)
    return _FOLDERS[app]


def hadoop_path(spark: SparkSession, folder: str):
    """The folder as the file system that holds it names it, and that file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def clear_work(spark: SparkSession) -> None:
    """Remove the application's intermediate tables now; its end removes them anyway.

    Results computed from them must have been written before.
    """
    path, files = hadoop_path(spark, work_folder(spark))
    files.delete(path, True)


def work_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet."""
    return f"{_INNER.get() or work_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def passing_work(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written in this thread's block go at its end.

    For work that repeats while an application lives, such as the batches of a stream.
    """
    folder = work_path(spark, "passing")
    token = _INNER.set(folder)
    try:
        yield
    finally:
        _INNER.reset(token)
        path, files = hadoop_path(spark, folder)
        files.delete(path, True)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query run in the block go when it ends.

    For queries that run once. Otherwise the files stay until the driver happens to
    collect its garbage, which an idle driver hardly does. Threads may share a session.
    """
    session = spark._jsparkSession.sessionUUID()
    with _LOCK:
        blocks, before = _CLEANING.get(session) or (0, spark.conf.get(SHUFFLE_CLEANUP, None))
        _CLEANING[session] = (blocks + 1, before)
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            blocks, before = _CLEANING.pop(session)
            if blocks > 1:
                _CLEANING[session] = (blocks - 1, before)
            elif before is None:
                spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, name: str = "table", path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet to the shared folder and read it back.

    Survives the loss of executors, keeps column pruning and gives the planner
    real sizes; the schema is passed on, so no inference job runs. The shuffle
    files behind it go once it is written.
    """
    spark = df.sparkSession
    path = path or work_path(spark, name)
    with passing_shuffles(spark):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_table(df: DataFrame, name: str = "table", codec: str | None = None) -> Iterator[DataFrame]:
    """``df`` written as by ``materialize`` and removed at the block's end.

    What is read from it must have been written by then.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    try:
        yield materialize(df, path=path, codec=codec)
    finally:
        folder, files = hadoop_path(spark, path)
        files.delete(folder, True)


def estimated_splits(df: DataFrame) -> int:
    """Splits that a scan of the planner's estimated size would have. Nothing is run."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return max(1, int(str(size)) // SPLIT_BYTES)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal out a table that is read in fewer splits than there are cores.

    For heavy work per row only. A large table has more splits than cores and is
    left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if estimated_splits(df) < cores else df
