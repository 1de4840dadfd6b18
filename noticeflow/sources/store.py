"""Keyed notice store on plain Parquet files, one folder per mode and day.

A merge finds where the changed keys lie, puts the touched partitions together anew and overwrites just these, with Spark's
own writer. It is repeatable: of two rows of a key the one with the greater arrival order stays, wherever it lies. It is not
a transaction: a reader may see some partitions before and some after a merge, and writers must take turns. A run that dies
while it places its partitions is to be repeated; the partitions that it was to place stay in the ``staging`` folder.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from datetime import date, timedelta
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.dates import UNDATED
from ..operators.dedup import last_write_wins
from ..session import hadoop_path

#: Partition columns beside ``mode`` and ``day``, which the files keep as they are, null included.
PLACE = ("p_mode", "p_day")


class NoticeStore:
    """Rows with ``mode``, ``day``, a key and an arrival order; one row per key."""

    def __init__(self, spark: SparkSession, root: str, key: str = "key", order: str = "seq"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.key = key
        self.order = order

    # ---- reading

    def daily_index(self) -> DataFrame:
        """(mode, date, path, count) of every partition, sorted by day and mode."""
        rows = self._stored()
        if rows is None:
            return self.spark.createDataFrame([], "mode string, date string, path string, count long")
        parts = self.spark.createDataFrame([(*p, f) for p, f in self._partitions().items()], "p_mode string, p_day string, path string")
        counts = rows.groupBy(*PLACE, "mode", F.col("day").alias("date")).count()
        same = [counts[c].eqNullSafe(parts[c]) for c in PLACE]
        # a row per mode and day
        return counts.join(F.broadcast(parts), same).select("mode", "date", "path", "count").orderBy("date", "mode")

    def read(self, begin: str | None = None, end: str | None = None, mode: str | None = None) -> DataFrame | None:
        """Rows of the partitions in range; None for an empty store."""
        rows = self._stored()
        if rows is None:
            return None
        if begin is not None:
            rows = rows.where(F.col("p_day") >= begin)
        if end is not None:
            rows = rows.where(F.col("p_day") <= end)
        if mode is not None:
            rows = rows.where(F.col("p_mode") == mode)
        return rows.drop(*PLACE)

    def read_latest(self, days: int = 7, mode: str | None = None) -> DataFrame | None:
        """Rows of the last ``days`` days up to the newest stored day, found by the names of the partitions."""
        stored = [day for _, day in self._partitions()]
        if not stored:
            return self.read()
        first = date.fromisoformat(max(stored)) - timedelta(days=days - 1)
        return self.read(begin=first.isoformat(), mode=mode)

    def _stored(self) -> DataFrame | None:
        """All rows with their places. The columns are those of the table in ``schema``, which holds no rows."""
        fs, path = hadoop_path(self.spark, f"{self.root}/schema")
        if not fs.exists(path):
            return None
        columns = self.spark.read.parquet(f"{self.root}/schema").schema
        fs.mkdirs(hadoop_path(self.spark, f"{self.root}/data")[1])
        places = [StructField(c, StringType()) for c in PLACE]
        return self.spark.read.schema(StructType([*columns.fields, *places])).parquet(f"{self.root}/data")

    def _partitions(self) -> dict[tuple[str | None, str | None], str]:
        """Folder of each (mode, day) that is stored."""
        found = {}
        for mode in self._folders("data", PLACE[0]):
            for day in self._folders(f"data/{mode}", PLACE[1]):
                values = [unquote(x.split("=", 1)[1]) for x in (mode, day)]
                place = tuple(None if v == "__HIVE_DEFAULT_PARTITION__" else v for v in values)
                found[place] = f"data/{mode}/{day}"
        return found

    def _folders(self, below: str, column: str) -> list[str]:
        fs, path = hadoop_path(self.spark, f"{self.root}/{below}")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if n.startswith(f"{column}="))

    # ---- writing

    def upsert(self, changes: DataFrame, batch_id: int | None = None, stream: str = "") -> DataFrame:
        """Merge changes by key and return those that could not be placed.

        A key whose day changed leaves its old partition. The row with the greater arrival
        order wins, stored or new, so a repeated or late batch does no harm. Changes without
        key or day are dead letters; what is stored for their keys stays. A batch that the same
        ``stream`` has merged already changes nothing, and its dead letters are returned again.
        """
        return self._merge(changes, None, batch_id, stream)

    def replace_scope(
        self, changes: DataFrame, mode: str | None, begin: str, end: str, scope: Column, batch_id: int | None = None, stream: str = ""
    ) -> DataFrame:
        """Delete the stored rows of a mode and day range that ``scope`` selects, and merge, in one write.

        Without a mode all modes are meant. Call it after the rows were read successfully.
        """
        inside = F.col("p_day").between(begin, end) & F.coalesce(scope, F.lit(False))
        if mode is not None:
            inside = inside & (F.col("p_mode") == mode)
        return self._merge(changes, inside, batch_id, stream)

    def _merge(self, changes: DataFrame, scope: Column | None, batch_id: int | None, stream: str) -> DataFrame:
        attempt = f"{self.root}/staging/{uuid.uuid4().hex}"
        placed = (F.coalesce(self.key, F.lit("")) != "") & (F.coalesce("day", F.lit(UNDATED)) != UNDATED)
        rejected = changes.where(~placed)
        fresh = changes.where(placed)
        if batch_id is not None:
            # rows of a batch that was merged before meet its mark and go no further
            marked = fresh.withColumns({"_stream": F.lit(stream), "_batch": F.lit(batch_id).cast("long")})
            fresh = marked.join(F.broadcast(self._batches()), ["_stream", "_batch"], "left_anti").drop("_stream", "_batch")
        # landed once: the batch is needed several times, and must not change on a task retry
        latest = _landed(last_write_wins(fresh, self.key, self.order), f"{attempt}/latest")
        stored = self._stored()
        if stored is None:
            self._place(latest, f"{attempt}/merged", [])
        else:
            stays = F.lit(True) if scope is None else ~F.coalesce(scope, F.lit(False))
            # key, place and order of the store meet the changes; the smaller side is sent to the other
            theirs = latest.select(self.key, F.col(self.order).alias("_new"))
            met = stored.where(stays).select(self.key, *PLACE, self.order).join(theirs, self.key)
            met = _landed(met.withColumn("_late", F.col(self.order) > F.col("_new")).select(self.key, *PLACE, "_late"), f"{attempt}/met")
            winners = latest.join(met.where("_late").select(self.key), self.key, "left_anti")
            touched = winners.select(*_place_columns()).union(met.where("NOT _late").select(*PLACE))
            if scope is not None:
                touched = touched.union(stored.where(scope).select(*PLACE))
            places = [tuple(r) for r in touched.distinct().collect()]  # at most one row per mode and day
            rest = stored.where(_in(places) & stays).drop(*PLACE).join(winners.select(self.key), self.key, "left_anti")
            self._place(rest.unionByName(winners, allowMissingColumns=True), f"{attempt}/merged", places)
        if batch_id is not None:
            self.spark.createDataFrame([(stream, batch_id)], _BATCHES).coalesce(1).write.mode("append").parquet(f"{self.root}/batches")
        fs, staging = hadoop_path(self.spark, attempt)
        fs.delete(staging, True)
        return rejected

    def _batches(self) -> DataFrame:
        """Batches that were merged: (_stream, _batch)."""
        fs, path = hadoop_path(self.spark, f"{self.root}/batches")
        if not fs.exists(path):
            return self.spark.createDataFrame([], _BATCHES)
        return self.spark.read.schema(_BATCHES).parquet(f"{self.root}/batches").distinct()

    def _place(self, rows: DataFrame, staging: str, places: list[tuple]) -> None:
        """Overwrite the partitions of the rows, and delete those of ``places`` that have no rows any more."""
        merged = _landed(rows, staging).withColumns(dict(zip(PLACE, _place_columns(), strict=True)))
        known = self._stored()
        if known is None or known.drop(*PLACE).columns != rows.columns:
            self.spark.createDataFrame([], rows.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/schema")
        # rebalancing cuts a day that holds many rows into several tasks and files
        writer = merged.hint("rebalance", *PLACE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*PLACE).parquet(f"{self.root}/data")
        left = {tuple(r) for r in merged.select(*PLACE).distinct().collect()}
        folders = self._partitions()
        fs, _ = hadoop_path(self.spark, self.root)
        for place in {*places} - left:
            if place in folders:
                fs.delete(hadoop_path(self.spark, f"{self.root}/{folders[place]}")[1], True)

    def compact(self, mode: Column | None = None, day: Column | None = None) -> None:
        """Rewrite everything: one row per key, each under its own (recomputed) mode and day.

        A row for which no day can be computed stays where it is.
        """
        rows = self.read()
        if rows is None:
            return
        if mode is not None:
            rows = rows.withColumn("mode", mode)
        if day is not None:
            dated = F.coalesce(day, F.lit(UNDATED)) != UNDATED
            rows = rows.withColumn("day", F.when(dated, day).otherwise(F.col("day")))
        attempt = f"{self.root}/staging/{uuid.uuid4().hex}"
        self._place(last_write_wins(rows, self.key, self.order), f"{attempt}/merged", list(self._partitions()))
        fs, staging = hadoop_path(self.spark, attempt)
        fs.delete(staging, True)


_BATCHES = "_stream string, _batch long"


def _place_columns() -> list[Column]:
    """Names of folders: an empty text is no folder's name and goes with null."""
    return [F.nullif(F.col(c), F.lit("")).alias(p) for c, p in zip(("mode", "day"), PLACE, strict=True)]


def _in(places: list[tuple]) -> Column:
    """Rows of these partitions, as a condition that prunes the others."""
    days = defaultdict(list)
    for mode, day in places:
        days[mode].append(day)
    found = F.lit(False)
    for mode, those in days.items():
        found = found | (F.col(PLACE[0]).eqNullSafe(mode) & F.col(PLACE[1]).isin(those))
    return found


def _landed(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merge_counts(previous: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("mode", "day")) -> DataFrame:
    """The same rule over count relations."""
    joined = previous.alias("p").join(current.alias("c"), list(keys), "full")
    return joined.select(*keys, F.coalesce("c.count", "p.count").alias("count"))


def daily_counts(df: DataFrame) -> DataFrame:
    """Rows per mode and day, sorted by day and mode."""
    return df.groupBy("mode", "day").count().orderBy("day", "mode")


def locate_existing(changes: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    """Changes with the mode and day under which their key is stored now, if any."""
    spots = stored.select(key, F.col("mode").alias("stored_mode"), F.col("day").alias("stored_day"))
    return changes.join(spots, key, "left")


# ---- job state, written after the data of the jobs


def complete_jobs(spark: SparkSession, root: str, jobs: DataFrame) -> None:
    jobs.write.mode("append").parquet(f"{root}/jobs")


def completed_jobs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    fs, path = hadoop_path(spark, f"{root}/jobs")
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/jobs").distinct()
