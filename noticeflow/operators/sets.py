"""Union, difference and distinct over relations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_columns(*frames: DataFrame) -> DataFrame:
    """Union whose columns are the ordered union of all columns; missing text becomes ''."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.fillna("")


def union_all(*frames: DataFrame) -> DataFrame:
    """Plain union; nothing is deduplicated."""
    return reduce(DataFrame.unionByName, frames)


def distinct_ids(df: DataFrame, keys: Sequence[str], identifier: str) -> DataFrame:
    return df.select(*keys, identifier).dropDuplicates()


def id_difference(left: DataFrame, right: DataFrame, keys: Sequence[str], identifier: str) -> DataFrame:
    """Distinct (keys, id) of ``left`` that ``right`` does not hold."""
    columns = [*keys, identifier]
    # Both sides are reduced to distinct ids first, so a hot key moves once per id.
    return left.select(*columns).distinct().join(right.select(*columns).distinct(), columns, "left_anti")


def missing_ids(expected: DataFrame, actual: DataFrame, keys: Sequence[str], identifier: str) -> DataFrame:
    return id_difference(expected, actual, keys, identifier)


def unexpected_ids(expected: DataFrame, actual: DataFrame, keys: Sequence[str], identifier: str) -> DataFrame:
    return id_difference(actual, expected, keys, identifier)


def declared_count(
    expected: DataFrame, declared: DataFrame, key: str, identifier: str, total: str
) -> DataFrame:
    """Compare a declared total with the number of distinct expected ids. Null totals pass."""
    # Distinct first: count_distinct on one hot key would gather its ids in one task.
    found = expected.select(key, identifier).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("listed"))
    joined = declared.join(found, key, "left")
    listed = F.coalesce(F.col("listed"), F.lit(0).cast("long"))
    return joined.select(
        key,
        F.col(total),
        listed.alias("listed"),
        (F.col(total).isNull() | (F.col(total) == listed)).alias("agrees"),
    )
