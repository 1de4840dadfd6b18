"""Token counts of a collection from the exact histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm import tables, tokens

#: Lengths summed up in one task.
RANGE = 1 << 10


def histogram(documents: DataFrame, tokenizer: str, text_col: str = "text", extra: int = 0) -> DataFrame:
    """``length, docs, tokens``: how many documents encode to each number of tokens.

    ``tokenizer`` is a file of the tokenizers library; ``extra`` tokens are added to every document. Whole texts are
    encoded; null and empty ones have no tokens of their own. Repeated rows count as often as they occur, other columns
    are ignored, an empty table gives no rows. Counts are summed up before the shuffle.
    """
    texts = documents.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in tokens.encoded(batches, tokenizer, 0):
            # the end id that the encoder appends is not counted
            sizes = [len(ids) - 1 + extra for ids in found]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["length"])

    lengths = texts.mapInArrow(count, "length long")
    return lengths.groupBy("length").agg(F.count("*").alias("docs"), F.sum("length").alias("tokens"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """The histogram with ``docs_longer`` and ``tokens_longer``, sums over all greater lengths, ``truncated_tokens``, the
    total if every document is cut to this length, and ``share``, the part of documents that are not longer.

    Sums run within ranges of lengths and then over the ranges, so that no task sees all lengths.
    """
    counts = tables.staged(counts, "histogram").withColumn("range", F.floor(F.col("length") / RANGE))
    ranges = counts.groupBy("range").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # a row per range of lengths
    over = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t"),
        F.sum("d").over(over).alias("all_docs"),
        F.sum("t").over(over).alias("all_tokens"),
    )
    within = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    docs = F.col("d") + F.coalesce(F.sum("docs").over(within), F.lit(0))
    longer = F.col("t") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    summed = counts.join(ranges, "range").withColumns({"docs_longer": docs, "tokens_longer": longer})
    return summed.select(
        "length", "docs", "tokens", "docs_longer", "tokens_longer",
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_tokens"),
        (1 - F.col("docs_longer") / F.col("all_docs")).alias("share"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``context, total_tokens, truncated_tokens, truncated_docs`` for each limit, from the suffix sums alone."""
    # sums just above a limit are those of the greatest length up to it, and all of them below the smallest length
    rows = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context")
    tried = sums.select(rows, "length", "docs", "tokens", "docs_longer", "tokens_longer")
    fits = F.when(F.col("length") <= F.col("context"), F.col("length"))
    found = tried.groupBy("context").agg(
        F.max_by(F.struct("docs_longer", "tokens_longer"), fits).alias("x"),
        F.max(F.col("docs_longer") + F.col("docs")).alias("all_docs"),
        F.max(F.col("tokens_longer") + F.col("tokens")).alias("total_tokens"),
    )
    docs = F.when(F.col("x").isNull(), F.col("all_docs")).otherwise(F.col("x.docs_longer"))
    longer = F.when(F.col("x").isNull(), F.col("total_tokens")).otherwise(F.col("x.tokens_longer"))
    cut = F.col("total_tokens") - longer + F.col("context") * docs
    return found.select("context", "total_tokens", cut.alias("truncated_tokens"), docs.alias("truncated_docs"))


def quantile(sums: DataFrame, share: float) -> int | None:
    """Smallest length that at least ``share`` of the documents do not exceed; None without documents."""
    return sums.where(F.col("share") >= share).agg(F.min("length")).first()[0]
