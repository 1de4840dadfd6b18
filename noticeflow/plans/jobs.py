"""Request plans: date chunks, jobs, pages, resume and range splitting."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import check_range, days_between
from ..session import checkpointed
from ..spec import FALLBACK_RANGE_DAYS, MAX_SPLIT_DEPTH, PAGE_SIZE


def date_chunks(spark: SparkSession, begin: date, end: date, days: int) -> DataFrame:
    """Inclusive chunks of ``days`` days; the last one is clipped."""
    check_range(begin, end)
    bounds = spark.range(1).select(F.lit(begin).alias("_begin"), F.lit(end).alias("_end"))
    return chunk_ranges(bounds, "_begin", "_end", days).drop("_begin", "_end")


def chunk_ranges(df: DataFrame, begin: str, end: str, days: int) -> DataFrame:
    """Cut the range of every row into chunks ``chunk``, ``chunk_begin``, ``chunk_end``."""
    starts = F.sequence(begin, end, F.expr(f"interval {int(days)} days"))
    cut = df.select("*", F.posexplode(starts).alias("chunk", "chunk_begin"))
    return cut.withColumn(
        "chunk_end", F.least(F.date_add("chunk_begin", days - 1), F.col(end))
    )


def plan_jobs(*dimensions: DataFrame) -> DataFrame:
    """Every combination of the dimensions with its ``job_id``.

    The dimensions are lists of settings (institutions or modes, business types, chunks).
    """
    plan = dimensions[0]
    for dimension in dimensions[1:]:
        plan = plan.crossJoin(dimension)
    return plan.withColumn("job_id", F.to_json(F.struct(*plan.columns)))


def page_count(total: Column, size: Column | int = PAGE_SIZE) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.greatest(F.lit(1), F.ceil(F.coalesce(total, F.lit(0)) / size)).cast("int")


def plan_pages(df: DataFrame, total: str, size: int = PAGE_SIZE) -> DataFrame:
    """One row per page to request; page 1 exists even for an empty result."""
    pages = page_count(F.col(total), size)
    return df.select("*", F.explode(F.sequence(F.lit(1), pages)).alias("page"))


def resume_pending(
    plan: DataFrame, completed: DataFrame, keys: Sequence[str] = ("job_id",), resume: bool = True
) -> DataFrame:
    """Planned rows that are not completed. ``keys`` holds the version where results have one."""
    if not resume:
        return plan
    return plan.join(completed.select(*keys), list(keys), "left_anti")


def _left_days(begin: str, end: str) -> Column:
    """Days of the first piece of a split range."""
    span = days_between(begin, end)
    return F.when(span > FALLBACK_RANGE_DAYS, F.lit(FALLBACK_RANGE_DAYS)).otherwise(
        F.floor(span / 2).cast("int")
    )


def split_ranges(
    df: DataFrame, failed: Column, begin: str = "chunk_begin", end: str = "chunk_end", depth: str = "depth"
) -> DataFrame:
    """One splitting round: failed ranges become two, others stay.

    Ranges over 28 days leave 28 days on the left, shorter ones are halved. A single day, or
    a range split ``MAX_SPLIT_DEPTH`` times, is not split further.
    """
    split = failed & (days_between(begin, end) > 1) & (F.col(depth) < MAX_SPLIT_DEPTH)
    middle = F.date_add(begin, _left_days(begin, end) - 1)
    whole = F.array(F.struct(F.col(begin).alias("b"), F.col(end).alias("e"), F.col(depth).alias("d")))
    halves = F.array(
        F.struct(F.col(begin).alias("b"), middle.alias("e"), (F.col(depth) + 1).alias("d")),
        F.struct(F.date_add(middle, 1).alias("b"), F.col(end).alias("e"), (F.col(depth) + 1).alias("d")),
    )
    ranges = F.explode(F.when(split, halves).otherwise(whole))
    rest = [c for c in df.columns if c not in (begin, end, depth)]
    return df.select(*rest, ranges.alias("_r")).select(
        *rest, F.col("_r.b").alias(begin), F.col("_r.e").alias(end), F.col("_r.d").alias(depth)
    )


def read_adaptive(
    plan: DataFrame, read: Callable[[DataFrame], DataFrame], learn_by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read a plan and read failed ranges again in smaller pieces.

    ``plan`` holds jobs with a range ``chunk_begin``, ``chunk_end``. ``read`` gets the ranges of a round (the plan's columns,
    ``depth``, and the range of the plan they came from in ``root_begin``, ``root_end``) and returns their rows with the
    columns of the range, ``status`` ('ok', 'transient', 'range_error' or 'error'), ``error``, and the items, of which a
    failed range may have brought a part. Each round is stored, so a status seen here is that of the items kept.

    The frontier of a round are the ranges that can be split; what they brought in part is dropped. Returns the landed
    rows; per range of the plan its ``outcome``: the error of the first piece that has one, and the number of pieces; and the
    shortest range learned so far, ``learned_days``, for each value of ``learn_by``.
    """
    spark = plan.sparkSession
    names = [*plan.columns, "depth", "root_begin", "root_end"]
    pending = plan.withColumns({"depth": F.lit(0), "root_begin": F.col("chunk_begin"), "root_end": F.col("chunk_end")})
    landed, learned = None, spark.createDataFrame([], plan.select(*learn_by, F.lit(0).alias("learned_days")).schema)
    while True:
        result = checkpointed(read(pending))
        splittable = (
            F.col("status").isin("transient", "range_error")
            & (days_between("chunk_begin", "chunk_end") > 1)
            & (F.col("depth") < MAX_SPLIT_DEPTH)
        )
        # a range has one row per item: ranges first, then the rows of those that stay
        frontier = checkpointed(result.where(splittable).select(*names).distinct())
        same = [result[c].eqNullSafe(frontier[c]) for c in names]
        done = result.join(frontier, same, "left_anti")
        landed = done if landed is None else landed.unionByName(done)
        if frontier.isEmpty():
            break
        seen = frontier.select(*learn_by, _left_days("chunk_begin", "chunk_end").alias("learned_days"))
        learned = checkpointed(learned.unionByName(seen).groupBy(*learn_by).agg(F.min("learned_days").alias("learned_days")))
        pending = split_ranges(frontier, F.lit(True))
    return landed, _outcomes(landed, plan.columns), learned


def _outcomes(landed: DataFrame, names: Sequence[str]) -> DataFrame:
    job = [c for c in names if c not in ("chunk_begin", "chunk_end")]
    pieces = landed.select(*job, "root_begin", "root_end", "chunk_begin", "chunk_end", "error").distinct()
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.struct("chunk_begin", "error")))
    return pieces.groupBy(*job, "root_begin", "root_end").agg(
        first.alias("error"), F.count_distinct("chunk_begin", "chunk_end").alias("pieces")
    )


def learned_chunks(bounds: DataFrame, learned: DataFrame, begin: str, end: str, days: int, learn_by: Sequence[str] = ()) -> DataFrame:
    """Cut ranges into chunks of ``days``, or of what was learned for their values of ``learn_by`` if that is shorter."""
    known = bounds.join(F.broadcast(learned), list(learn_by), "left") if learn_by else bounds.crossJoin(F.broadcast(learned))
    span = F.least(F.lit(days), F.coalesce("learned_days", F.lit(days)))
    cut = known.withColumn("_days", span).withColumn(
        "_starts", F.expr(f"transform(sequence(0, datediff({end}, {begin}), _days), d -> date_add({begin}, d))")
    )
    placed = cut.select(*bounds.columns, "_days", F.posexplode("_starts").alias("chunk", "chunk_begin"))
    return placed.withColumn("chunk_end", F.least(F.expr("date_add(chunk_begin, _days - 1)"), F.col(end))).drop("_days")
