"""CSV files: the daily store format, and reports for spreadsheets."""

from __future__ import annotations

import csv
import re
import uuid
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.cells import as_text, csv_escape, text_cell, untext_cell
from ..functions.text import join_text
from ..operators.sets import union_columns
from ..session import hadoop_path

BOM = "\ufeff"
# Fixed value: modes of daily files, which lie in mode/yyyy/MM/dd.csv.gz
MODES = ("bid", "pre")

# Quotes are doubled, and no space or empty value is altered on the way.
_FORMAT = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_daily(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """Read daily files: text columns, missing cells '', empty lines dropped.

    Cells go by the names in the header of their own file, which is its first line: headers may differ in order and in
    columns, and the result has the columns of all of them. Files without a line are left out. Column names hold no
    line breaks.
    """
    by_header = defaultdict(list)
    for header, path in headers(spark, paths, **options):
        by_header[header].append(path)
    if not by_header:
        return spark.createDataFrame([], "struct<>")
    return union_columns(*[_read_alike(spark, group, names, options) for names, group in by_header.items()])


def headers(spark: SparkSession, paths: str | Sequence[str], **options) -> list[tuple[tuple[str, ...], str]]:
    """(column names, path) of each file, by path. Tasks read lines one at a time, and a row per file reaches the driver."""
    lines = spark.read.options(**options).text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("at"),
    )
    first = lines.where("start = 0").groupBy("path").agg(F.min_by("value", "at").alias("line"))
    found = []
    for path, line in sorted(tuple(r) for r in first.collect()):
        [names] = csv.reader([line.removeprefix(BOM)])
        found.append((tuple(names), unquote(path)))
    return found


def _read_alike(spark: SparkSession, paths: list[str], names: Sequence[str], options: dict) -> DataFrame:
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    df = spark.read.options(**_FORMAT, **options).schema(schema).csv(paths, multiLine=True)
    blank = reduce(Column.__and__, [F.coalesce(F.col(c), F.lit("")) == "" for c in df.columns])
    return df.where(~blank).select(*[untext_cell(F.col(c)).alias(n) for c, n in zip(df.columns, names, strict=True)])


def list_partitions(
    spark: SparkSession,
    root: str,
    begin: str | None = None,
    end: str | None = None,
    mode: str | None = None,
    modes: Sequence[str] = MODES,
) -> DataFrame:
    """Daily files below ``root`` as (mode, day, path), sorted. Reads no content.

    Only the folders of the months between ``begin`` and ``end`` are listed; without one of them, the months that a mode
    has. A day with a plain and a compressed file has both.
    """
    found = []
    for name in [mode] if mode else modes:
        first, last = (begin or "0000-00")[:7], (end or "9999-99")[:7]
        for month in _months(spark, f"{root}/{name}", first, last):
            for path in _listed(spark, f"{root}/{name}/{month.replace('-', '/')}"):
                file = re.fullmatch(r"(\d{2})\.csv(\.gz)?", path.rsplit("/", 1)[1])
                day = f"{month}-{file[1]}" if file else ""
                if file and (begin or day) <= day <= (end or day):
                    found.append((day, name, path))
    rows = [(name, day, path) for day, name, path in sorted(found)]
    return spark.createDataFrame(rows, "mode string, day string, path string").orderBy("day", "mode", "path")


def _months(spark: SparkSession, root: str, first: str, last: str) -> list[str]:
    if first > "0000-00" and last < "9999-99":
        begin, end = (int(x[:4]) * 12 + int(x[5:]) - 1 for x in (first, last))
        return [f"{i // 12:04d}-{i % 12 + 1:02d}" for i in range(begin, end + 1)]
    years = [p for p in _listed(spark, root) if first[:4] <= p.rsplit("/", 1)[1] <= last[:4]]
    months = ["-".join(p.rsplit("/", 2)[1:]) for year in years for p in _listed(spark, year)]
    return [m for m in months if first <= m <= last]


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """Paths in a folder; none where there is no folder."""
    fs, path = hadoop_path(spark, folder)
    if not fs.exists(path):
        return []
    return sorted(status.getPath().toString() for status in fs.listStatus(path))


def write_daily_files(rows: DataFrame, root: str, order: Sequence[str], item: str = "item") -> None:
    """Write items (``mode``, ``day`` as yyyy-MM-dd, ``item`` as a map of texts) as ``mode/yyyy/MM/dd.csv.gz``.

    A file starts with a byte-order mark; its header holds the keys of its items, in the order in which they first come
    up along ``order``. Cells are forced text, lacking and empty ones stay empty. The files of the given days are replaced, other days
    stay. A daily file is one stream, so one task writes it; its rows are sorted on disk, not held. Files are put in place one by one after all are written.
    """
    spark = rows.sparkSession
    place = F.struct(*order)
    keys = rows.select("mode", "day", place.alias("_o"), F.posexplode(F.map_keys(item)).alias("_i", "key"))
    first = keys.groupBy("mode", "day", "key").agg(F.min(F.struct("_o", "_i")).alias("_first"))
    columns = first.groupBy("mode", "day").agg(F.array_sort(F.collect_list(F.struct("_first", "key")))["key"].alias("columns"))
    # a row per mode and day; numbers make plain folder names, and keep the order of the rows as it is
    files = [tuple(r) for r in columns.select("mode", "day").orderBy("day", "mode").collect()]
    numbers = F.broadcast(spark.createDataFrame([(*f, i) for i, f in enumerate(files)], "mode string, day string, file int"))
    lines = rows.join(columns, ["mode", "day"]).join(numbers, ["mode", "day"]).select(
        "file", F.lit(1).alias("_part"), place.alias("_o"),
        F.array_join(F.transform("columns", lambda key: _cell(F.col(item), key)), ",").alias("value"),
    )
    heads = columns.join(numbers, ["mode", "day"]).select(
        "file", F.lit(0).alias("_part"), F.lit(None).cast(lines.schema["_o"].dataType).alias("_o"),
        F.concat(F.lit(BOM), F.array_join("columns", ",")).alias("value"),
    )
    staging = f"{root}/_staging-{uuid.uuid4().hex[:12]}"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = heads.union(lines).repartition(tasks, "file").sortWithinPartitions("file", "_part", "_o")
    dealt.select("file", "value").write.partitionBy("file").text(staging, compression="gzip")
    fs, _ = hadoop_path(spark, root)
    for folder in (f for f in _listed(spark, staging) if "/file=" in f):
        mode, day = files[int(folder.rsplit("=", 1)[1])]
        [part] = [p for p in _listed(spark, folder) if "/part-" in p]
        _, target = hadoop_path(spark, f"{root}/{mode}/{day.replace('-', '/')}.csv.gz")
        fs.mkdirs(target.getParent())
        fs.delete(target, False)
        if not fs.rename(hadoop_path(spark, part)[1], target):
            raise OSError(f"cannot place {target.toString()}")
    fs.delete(hadoop_path(spark, staging)[1], True)


def _cell(item: Column, key: Column) -> Column:
    value = text_cell(F.try_element_at(item, key))
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value == "", value).otherwise(quoted)


def write_daily(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Write cells as forced text, gzip-compressed; nested values become JSON.

    With ``partition`` the rows of one partition value are spread over as many files as their
    size needs.
    """
    cells = df.select(
        *[
            F.col(_q(f.name)) if f.name in partition else text_cell(as_text(_q(f.name), f.dataType)).alias(f.name)
            for f in df.schema.fields
        ]
    )
    if partition:
        cells = cells.hint("rebalance", *partition)
    writer = cells.write.mode("overwrite").options(**_FORMAT, compression="gzip")
    if partition:
        writer = writer.partitionBy(*partition)
    writer.csv(path)


def attachment_text(files: Column) -> Column:
    """Attachments as ``name (url)`` joined by `` | ``."""
    shown = F.transform(files, lambda f: F.concat(f["name"], F.lit(" ("), f["url"], F.lit(")")))
    return join_text(shown, " | ", default=None)


def export_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One CSV line per row, in the order of ``columns``; quotes only where needed."""
    cells = [
        csv_escape(attachment_text(F.col(c)) if c == "files" else as_text(c, df.schema[c].dataType))
        for c in columns
    ]
    return df.withColumn("line", F.concat_ws(",", *cells))


def write_report(lines: DataFrame, header: Sequence[str], path: str, *order) -> None:
    """Write sorted report lines below ``path``: ``header`` (with a byte-order mark) and ``rows``.

    The part files of ``rows`` are in order, so header and parts in name order are the report.
    """
    head = lines.sparkSession.range(1, numPartitions=1).select(F.lit(BOM + ",".join(header)).alias("value"))
    head.write.mode("overwrite").text(f"{path}/header")
    rows = lines.orderBy(*order).select(F.col("line").alias("value"))
    rows.write.mode("overwrite").text(f"{path}/rows")


def _q(name: str) -> str:
    return f"`{name}`"
