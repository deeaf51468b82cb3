"""Intermediate results in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_FREEING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# A table of at most this many narrow rows is safe to broadcast.
BROADCAST_ROWS = 100_000

_local_folders: list[tempfile.TemporaryDirectory] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a local-mode session that names none gets a temporary folder; on a
    cluster a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get(_SETTING, None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
        _local_folders.append(tempfile.TemporaryDirectory(prefix="textvariety-"))
        folder = _local_folders[-1].name
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch root."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Compute once: write to the scratch root and read back.

    `codec` packs the files, by default as the session does. Cuts lineage and survives the loss of executors. Unlike an RDD checkpoint
    it computes the rows a single time, and leaves columns prunable and sizes
    known to the planner.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job are deleted as it ends, not when the driver collects
    its garbage. For jobs whose results are stored or collected."""
    before = spark.conf.get(_FREEING, None)
    spark.conf.set(_FREEING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREEING)
        else:
            spark.conf.set(_FREEING, before)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a stored table whose size passes the check."""
    return F.broadcast(df) if df.count() <= max_rows else df


def discard(stored: DataFrame) -> None:
    """Delete the files of a table that `store` gave, once its job is done."""
    spark = stored.sparkSession
    root = scratch_root(spark).rstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in stored.inputFiles()}:
        name = folder.rsplit("/", 1)[1]
        if name.startswith("table-"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """Stored tables of one job, deleted together once nothing reads them."""

    def __init__(self) -> None:
        self._stored: list[DataFrame] = []

    def add(self, df: DataFrame) -> DataFrame:
        """Of what reads stored tables, these are deleted."""
        self._stored.append(df)
        return df

    def store(self, df: DataFrame) -> DataFrame:
        return self.add(store(df))

    def discard(self) -> None:
        while self._stored:
            discard(self._stored.pop())
