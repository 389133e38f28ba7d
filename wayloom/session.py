"""Session defaults and the shared scratch location."""

from __future__ import annotations

import atexit
import datetime as dt
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def session(app: str = "wayloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC clock and adaptive execution; ``conf`` overrides, ``_`` stands for ``.``."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a temporary folder that is
    removed at exit. On a cluster a machine-local folder would be invisible to the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="wayloom-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def stage(table: DataFrame, partition_by: str | None = None, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: computed once, and the lineage is cut.

    With ``path``, a :func:`scratch_path`, the caller can :func:`discard` it after use.
    """
    spark = table.sparkSession
    path = path or scratch_path(spark, "stage")
    writer = table.write.partitionBy(partition_by) if partition_by else table.write
    writer.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def _on_file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder, on whatever file system it lies."""
    target, files = _on_file_system(spark, path)
    files.delete(target, True)


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob pattern finds anything."""
    target, files = _on_file_system(spark, pattern)
    found = files.globStatus(target)
    return found is not None and len(found) > 0


def listing(spark: SparkSession, pattern: str) -> list[tuple[str, bool]]:
    """Paths that a path or glob pattern finds, each with whether it is a folder."""
    target, files = _on_file_system(spark, pattern)
    return [(s.getPath().toString(), s.isDirectory()) for s in files.globStatus(target) or []]


def set_times(spark: SparkSession, path: str, at: dt.datetime) -> None:
    """Set the modification time of the files of a folder."""
    for found, _ in listing(spark, f"{path}/*"):
        target, files = _on_file_system(spark, found)
        files.setTimes(target, int(at.timestamp() * 1000), -1)


def spread(table: DataFrame, partitions: int | None) -> DataFrame:
    """Deal rows over as many tasks before costly work on each, or leave them as scanned.

    A few small files make a few tasks; whoever knows that says so. Large inputs are split by
    their scan already and need no number.
    """
    return table.repartition(partitions) if partitions else table
