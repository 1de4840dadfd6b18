"""Shared folders for checkpoints and written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach.

    Taken from ``spark.checkpoint.dir``. Only a local session, where driver and executors
    are one process, may fall back to a folder of its own, below the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _local_roots:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        _local_roots[application] = f"{warehouse}/.noticeflow-{uuid.uuid4().hex[:12]}"
        _delete_on_exit(spark, _local_roots[application])
    return _local_roots[application]


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared root, removed when the session's JVM ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _delete_on_exit(spark, path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so that a lost executor repeats nothing."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(spark, "checkpoints"))
    return df.checkpoint()


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) handles for driver-side metadata work."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    fs, jpath = hadoop_path(spark, path)
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
