"""Written intermediate tables and checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.session import work_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Jobs that are started inside run with this setting."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there, and it is computed once."""
    spark = df.sparkSession
    path = work_dir(spark, label) + "/table"
    # nothing reads the shuffles of this job once its table is written
    with setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """The table marked for broadcast if it has at most ``most_rows`` rows; otherwise joins of it shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
