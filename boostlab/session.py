"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
# Bytes of blocks that a Python worker gets at once; a larger block comes alone.
BATCH_BYTES = 4 << 20
_open = threading.local()


def local_session(cores: int | str = "*", app: str = "boostlab", memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and benchmarks. Clusters bring their own."""
    parallel = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.python.unix.domain.socket.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary
    folder, since driver and executors are one process there.
    """
    context = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if path:
        return path
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="boostlab-"))
    return context.getCheckpointDir()


def steady_session(spark: SparkSession) -> SparkSession:
    """Another session of the application with the same settings but for adaptive planning,
    for loops of many short jobs whose plans need no second look.

    Their rows are blocks of some thousand rows each, and Arrow batches are cut by rows, at
    64 MB at most: a worker would hold several times that. Here batches are small, so
    what workers hold does not depend on the size of their tasks."""
    steady = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            steady.conf.set(key, value)
    steady.conf.set("spark.sql.adaptive.enabled", "false")
    steady.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    return steady


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept as a table in the shared folder.

    What reads them again neither repeats the work before nor depends on an
    executor that held them.
    """
    path = run_dir(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/boostlab-{spark.sparkContext.applicationId}"


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A folder under the shared one that no other run uses."""
    path = f"{_home(spark)}/{purpose}-{uuid.uuid4().hex}"
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that this thread asks for inside the block are deleted at its end. Rows that
    are read from them must have been used by then."""
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        paths, _open.paths = _open.paths, outer
        for path in paths:
            drop_dir(spark, path)


def settled_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """The rows ``make`` gives, settled, and their folder; every other folder made for them
    is deleted."""
    path = run_dir(spark, "settled")
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`run_dir`."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def drop_run_dirs(spark: SparkSession) -> None:
    """Delete every folder of this application; call it when its results are used up."""
    drop_dir(spark, _home(spark))
