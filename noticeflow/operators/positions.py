"""Positions and running sums inside ordered groups of any size.

A window over ``partitionBy(group)`` puts each group into one task. Here the keys of all rows are range-partitioned by
group and order, numbered inside each range, and shifted by the sizes of the ranges before it, so that a
group may be larger than a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Rows that a page may take from the start of an ordered result.
HEAD = 10_000


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    name: str,
    value: Column | None = None,
    before: bool = False,
) -> DataFrame:
    """Add the running sum of ``value`` (default: the 1-based position) along ``order``.

    ``before`` leaves the row's own value out. ``order`` must be unique within a group.
    An empty ``group`` treats the whole table as one group. Named columns make a row's key: only they are sorted and
    stored, and the rest of a row is joined by them. An ``order`` of other expressions sorts whole rows.
    """
    value = F.lit(1).cast("long") if value is None else value.cast("long")
    keys = [*group, *order]
    if not all(isinstance(k, str) for k in keys) or {*df.columns} <= {*keys}:
        return _by_range(df.withColumn(name, value), group, order, name, before)
    placed = _by_range(df.select(*dict.fromkeys(keys), value.alias(name)), group, order, name, before)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}")) for k in dict.fromkeys(keys)]
    joined = df.alias("r").join(placed.alias("k"), same)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns if c != name], F.col(f"k.{name}"))


def _frame(group: Sequence[str], order: Sequence[str | Column], before: bool):
    last = -1 if before else Window.currentRow
    return Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)


def _by_window(df, group, order, name, before) -> DataFrame:
    total = F.sum(name).over(_frame(group, order, before))
    return df.withColumn(name, F.coalesce(total, F.lit(0)))


def _by_range(df, group, order, name, before) -> DataFrame:
    """Two-level running sum: inside each range, then over the ranges."""
    # Range bounds are sampled: storing the placed rows keeps both uses below consistent,
    # also when a lost executor makes Spark repeat a part.
    placed = checkpointed(
        df.orderBy(*group, *order).withColumn("_range", F.spark_partition_id())
    )
    pieces = placed.groupBy(*group, "_range").agg(F.sum(name).alias("_piece"))
    # One row per group and range; adaptive execution broadcasts them if they are few.
    earlier = _frame(group, ["_range"], before=True) if group else (
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    pieces = pieces.withColumn("_shift", F.coalesce(F.sum("_piece").over(earlier), F.lit(0)))
    inside = _by_window(placed, [*group, "_range"], order, name, before)
    same = [F.col(f"i.{g}").eqNullSafe(F.col(f"p.{g}")) for g in [*group, "_range"]]
    joined = inside.alias("i").join(pieces.alias("p"), same)
    columns = [
        (F.col(f"i.{c}") + F.col("p._shift")).alias(c) if c == name else F.col(f"i.{c}")
        for c in df.columns
    ]
    return joined.select(*columns)


def slot_number(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], **options
) -> DataFrame:
    """1-based ``slot`` inside the group, and its two-digit label."""
    numbered = running(df, group, order, "slot", **options)
    return numbered.withColumn("slot_label", _two_digits(F.col("slot")))


def _two_digits(slot: Column) -> Column:
    text = slot.cast("string")
    return F.when(slot < 10, F.concat(F.lit("0"), text)).otherwise(text)


def chunk_ids(
    df: DataFrame, group: Sequence[str], order: Sequence[str], identifier: str, size: int, **options
) -> DataFrame:
    """Consecutive groups of at most ``size`` ids: one row per chunk with its ids in order."""
    keys = df.select(*dict.fromkeys([*group, *order, identifier]))
    numbered = running(keys, group, order, "_pos", **options)
    chunked = numbered.withColumn("chunk", F.floor((F.col("_pos") - 1) / size))
    members = F.array_sort(F.collect_list(F.struct("_pos", F.col(identifier).alias("id"))))
    return (
        chunked.groupBy(*group, "chunk")
        .agg(members.alias("_members"))
        .select(*group, "chunk", F.col("_members.id").alias("ids"))
    )


def page(
    df: DataFrame, order: Sequence[str], number: int = 1, size: int = 50, descending: Sequence[str] = (), head: int = HEAD
) -> DataFrame:
    """One page of a result ordered by columns, with ``page`` and ``pages``. The number is clamped.

    Columns in ``descending`` run downwards, with nulls last; the others upwards, with nulls first. Rows alike in all
    of them may stand in any order. Up to ``head`` rows are cut from the first ones in order. A deeper page is looked for
    by counts: the order columns alone are dealt into ranges, and only the rows between the bounds of the page's ranges go
    on, until they are few.
    """
    rows = df.count()
    pages = max(1, -(-rows // size))
    number = min(max(1, number), pages)
    skip, left, part = (number - 1) * size, rows, df
    while skip + size > head and left > head:
        ranges = _range_counts(part, order, descending)
        at, within = 0, []
        for count, first, last in ranges:
            if at < skip + size and at + count > skip:
                within.append((at, count, first, last))
            at += count
        if len(within) == len(ranges):  # equal keys alone fill the ranges
            break
        low, high = within[0][2], within[-1][3]
        part = part.where(_not_before(order, low, descending) & _not_before(order, high, descending, after=True))
        skip -= within[0][0]
        left = sum(count for _, count, *_ in within)
    shown = part.orderBy(*_directed(order, descending)).offset(skip).limit(size)
    return shown.withColumns({"page": F.lit(number), "pages": F.lit(pages)})


def _directed(order: Sequence[str], descending: Sequence[str]) -> list[Column]:
    return [F.col(c).desc() if c in descending else F.col(c).asc() for c in order]


def _range_counts(df: DataFrame, order: Sequence[str], descending: Sequence[str]) -> list[tuple]:
    """(rows, first key, last key) of ranges of the order columns, in order. A row per range reaches the driver."""
    ranged = df.select(*order).orderBy(*_directed(order, descending)).withColumn("_at", F.monotonically_increasing_id())
    key = F.struct(*order)
    counted = ranged.groupBy(F.shiftrightunsigned("_at", 33).alias("_range")).agg(
        F.count("*").alias("n"), F.min_by(key, "_at").alias("first"), F.max_by(key, "_at").alias("last")
    )
    ranges: list[tuple] = []
    for n, first, last in counted.orderBy("_range").select("n", "first", "last").collect():
        if ranges and ranges[-1][2] == first:  # equal keys are one range
            n, first = n + ranges[-1][0], ranges.pop()[1]
        ranges.append((n, first, last))
    return ranges


def _not_before(order: Sequence[str], key: Sequence, descending: Sequence[str], after: bool = False) -> Column:
    """Rows that do not come before the key, or with ``after``, not after it."""
    found = F.lit(True)
    for name, value in reversed(list(zip(order, key, strict=True))):
        column, down = F.col(name), name in descending
        if value is None:
            beyond = F.lit(False) if down != after else column.isNotNull()
        else:
            beyond = column < value if down != after else column > value
            if (down and not after) or (not down and after):
                beyond = beyond | column.isNull()
        found = F.coalesce(beyond, F.lit(False)) | (column.eqNullSafe(value) & found)
    return found


def grid_columns(
    df: DataFrame, row: Sequence[str], order: Sequence[str], col_span: str = "col_span", **options
) -> DataFrame:
    """0-based start column of each cell in tables without row spans."""
    return running(df, row, order, "start_col", F.col(col_span), before=True, **options)
