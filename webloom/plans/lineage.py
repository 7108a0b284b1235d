"""Lineage cuts that survive lost executors, and sizes known before a plan runs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that ends inside go at once, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting
    gets a temporary folder, because there every task runs on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="webloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    For results that several later steps read. Unlike a cache the table outlives executors, is
    column-pruned and filtered by its readers, and gives the optimizer true sizes. What the frame shuffled is
    removed once it is written.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a frame, for loops."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def discard(*frames: DataFrame) -> None:
    """Delete the files of checkpoints and stored tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        plan = df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() == "LogicalRDD":
            paths = [plan.rdd().getCheckpointFile().get()]
        else:
            paths = [root.toString() for root in _roots(plan)]
        discard_folders(spark, *paths)


def _file_system(spark: SparkSession, path: str):
    """The path and its file system, as Spark sees them. These calls need a classic session, not Spark Connect."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _file_system(spark, path)
    return system.exists(where)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in order; none if it is not there."""
    where, system = _file_system(spark, path)
    if not system.exists(where):
        return []
    return sorted(found.getPath().getName() for found in system.listStatus(where) if found.isDirectory())


def discard_folders(spark: SparkSession, *paths: str) -> None:
    """Delete folders through Spark's file systems; one that is not there is no fault."""
    for path in paths:
        where, system = _file_system(spark, path)
        system.delete(where, True)


def _roots(plan) -> list:
    """Folders that a plain table scan reads."""
    paths = plan.relation().location().rootPaths()
    return [paths.apply(i) for i in range(paths.size())]


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Share rows out over tasks before heavy work per row, at the price of a shuffle.

    For tables of fewer files and row groups than cores, which only the caller can know: a Parquet row
    group is read by one task. ``tasks`` is the default parallelism unless it is given.
    """
    return df.repartition(tasks or df.sparkSession.sparkContext.defaultParallelism)
