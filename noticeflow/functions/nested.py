"""Arrays to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(
    df: DataFrame, keep: Sequence[Column | str], array: Column, value: str, position: str = "_pos"
) -> DataFrame:
    """One row per array entry with its 0-based position; empty arrays give none.

    Written with the outer form, because the inner one makes the optimizer add a filter on the
    size of the array, which would evaluate a costly array a second time.
    """
    exploded = df.select(*keep, F.posexplode_outer(array).alias(position, value))
    return exploded.where(F.col(position).isNotNull())
