"""Landed files, failures and JSON indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import base_name


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every file of every notice directory: notice, name, path, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(
        F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("notice"),
        base_name("path").alias("name"),
        "path",
        "length",
        "content",
    )


def take_sorted(df: DataFrame, key: str, limit: int | None) -> DataFrame:
    """Rows of the first ``limit`` distinct keys in order."""
    if limit is None:
        return df
    first = df.select(key).distinct().orderBy(key).limit(limit)
    return df.join(first, key, "left_semi")


def fetch_check(status: Column, content_type: Column, length: Column) -> Column:
    """Reason why a fetched file is rejected; null when it is good."""
    return (
        F.when(~status.between(200, 299), F.concat(F.lit("HTTP "), status.cast("string")))
        .when(content_type.rlike(r"(?i)^text/html\b"), F.lit("html"))
        .when(F.coalesce(length, F.lit(0)) == 0, F.lit("empty"))
    )


def to_fetch(wanted: DataFrame, existing: DataFrame, target: str = "target") -> DataFrame:
    """Wanted files that are not there yet with content."""
    there = existing.where(F.col("length") > 0).select(target)
    return wanted.join(there, target, "left_anti")


def tag_failures(df: DataFrame, failed: Column, reason: Column) -> DataFrame:
    """Mark each row as ``ok`` or ``failed`` with its reason, for two sinks."""
    return df.withColumns(
        {
            "outcome": F.when(failed, F.lit("failed")).otherwise(F.lit("ok")),
            "reason": F.when(failed, reason),
        }
    )


def split_dead_letter(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successes and failures of :func:`tag_failures`."""
    good = tagged.where(F.col("outcome") == "ok").drop("outcome", "reason")
    return good, tagged.where(F.col("outcome") == "failed").drop("outcome")


def write_index(entries: DataFrame, path: str, order: Sequence[str | Column]) -> None:
    """Write a sorted index as JSON lines; part files are in order."""
    entries.orderBy(*order).write.mode("overwrite").json(path)
