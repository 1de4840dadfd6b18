"""First, latest and last copy per key.

All three are aggregations rather than windows: each map task sends at most one row per key,
so a key that holds a large share of all rows is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = str | Sequence[str]


def _names(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _order(columns: Keys) -> Column:
    return F.struct(*_names(columns))


def keep_first(
    df: DataFrame,
    key: str,
    order: Keys,
    blank_key: str = "keep",
    copies: str | None = None,
) -> DataFrame:
    """The first row of each key by ``order``, which must be unique.

    Rows with a blank key are all kept or all dropped. ``copies`` names a column that counts
    the rows dropped in favour of the kept one.
    """
    if blank_key not in ("keep", "drop"):
        raise ValueError(f"blank_key: {blank_key}")
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    rest = [c for c in df.columns if c != key]
    if blank_key == "drop":
        df = df.where(~blank)
    # Rows without a key are groups of their own, named by their place in the order.
    own = F.when(blank, _order(order)).alias("_own")
    aggregates = [F.min_by(F.struct(*rest), _order(order)).alias("_row")]
    if copies:
        aggregates.append((F.count(F.lit(1)) - 1).alias(copies))
    first = df.groupBy(key, *([own] if blank_key == "keep" else [])).agg(*aggregates)
    columns = [F.col(c) if c == key else F.col("_row")[c].alias(c) for c in df.columns]
    return first.select(*columns, *([copies] if copies else []))


def latest_per_key(df: DataFrame, key: Keys, date: str, arrival: str) -> DataFrame:
    """The row with the greatest date of each key; the first arrival among equal dates."""
    keys = _names(key)
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(date), -F.col(arrival)))
    picked = df.groupBy(*keys).agg(newest.alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def last_write_wins(
    df: DataFrame, key: Keys, order: Keys, position: str | None = None
) -> DataFrame:
    """The last row of each key by ``order``; ``position`` keeps where the key was first seen."""
    keys = _names(key)
    rest = [c for c in df.columns if c not in keys]
    aggregates = [F.max_by(F.struct(*rest), _order(order)).alias("_row")]
    if position:
        aggregates.append(F.min(_names(order)[0]).alias(position))
    picked = df.groupBy(*keys).agg(*aggregates)
    columns = [F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns]
    return picked.select(*columns, *([position] if position else []))
