"""Mixing of sources by temperature, dealt out in blocks. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm import tables

#: Halvings of the exponent's interval, and how many of them one pass over the sources decides.
HALVINGS, AT_ONCE = 40, 4


def word_count(text: str) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mixture:
    """``weights`` (source, tokens, docs, weight, quota in tokens), the exponent, its entropy, and the budget in tokens."""

    weights: DataFrame
    exponent: float
    entropy: float
    budget: float


def mixture(counts: DataFrame, entropy: float | None = None, most_passes: float | None = None, budget: float | None = None) -> Mixture:
    """Weights in proportion to token shares raised to an exponent from 0 (all alike) to 1 (as they are).

    ``counts``: (source, tokens, docs). The smallest exponent is found by bisection for which the entropy of the weights
    is at most the share ``entropy`` of its maximum, and no source is passed over more than ``most_passes`` times. Both
    fall as the exponent grows, from which follows that a limit beyond reach gives exponent 1. ``budget``: tokens of the
    mixture; by default so many that the source with the fewest passes has one. Sources without tokens have weight 0.
    """
    counts = tables.staged(counts, "sources")
    total, n = counts.where("tokens > 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    share = F.col("tokens") / F.lit(float(max(total, 1)))
    used = counts.where("tokens > 0").withColumn("share", share)

    def measure(exponents: list[float]) -> dict[float, tuple[float, float, float]]:
        """Entropy, passes over the source that has most, and budget, by exponent."""
        tried = used.select("tokens", "share", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        raised = F.pow("share", "a")
        rows = tried.groupBy("a").agg(
            F.sum(raised).alias("s"), F.sum(raised * F.log("share")).alias("l"),
            F.max(raised / F.col("tokens")).alias("most"), F.min(raised / F.col("tokens")).alias("least"),
        ).collect()
        out = {}
        for a, s, logs, most, least in rows:
            size = s / least if budget is None else budget
            out[a] = (math.log(s) - a * logs / s, most * size / s, size)
        return out

    def fits(measured: tuple[float, float, float]) -> bool:
        level, passes, _ = measured
        return (entropy is None or level <= entropy * math.log(n) + 1e-12) and (most_passes is None or passes <= most_passes)

    if not n:
        weights = counts.withColumns({"weight": F.lit(0.0), "quota": F.lit(0.0)})
        return Mixture(weights, 1.0, 0.0, 0.0)
    low, high = 0.0, 1.0
    if fits(measure([0.0])[0.0]):
        high = 0.0
    else:
        for _ in range(HALVINGS // AT_ONCE):
            # one job measures all the middles that the next halvings can meet
            steps = 1 << AT_ONCE
            grid = [low + (high - low) * i / steps for i in range(1, steps)]
            measured = measure(grid)
            first, last = 0, steps
            while last - first > 1:
                middle = (first + last) // 2
                first, last = (first, middle) if fits(measured[grid[middle - 1]]) else (middle, last)
            low, high = (grid[first - 1] if first else low), (grid[last - 1] if last < steps else high)
    level, _, size = measure([high])[high]
    scale = used.agg(F.sum(F.pow("share", F.lit(high)))).first()[0]
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(high)) / F.lit(scale)).otherwise(F.lit(0.0))
    weights = counts.withColumn("weight", weight).withColumn("quota", F.col("weight") * F.lit(float(size)))
    return Mixture(tables.staged(weights, "weights"), high, level, float(size))


def mix(
    documents: DataFrame,
    source_col: str,
    tokens_col: str,
    entropy: float | None = 0.9,
    most_passes: float | None = 4.0,
    budget: float | None = None,
    block_tokens: int = 1 << 20,
    bucket_docs: int = 10_000,
    seed: int = 42,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """Documents in the order of a mixture: ``document`` (a struct of all columns), ``source, pass, block, position``.

    Each pass over a source takes its documents in another random order, and the last one ends where the quota is met
    (with the document that reaches it). A source's stream is laid evenly over the mixture and cut into blocks of about
    ``block_tokens``, so that every block has the weights of the whole; ``position`` orders the documents of a block.

    Null is a source of its own. Null token counts are 0; documents without tokens come with their neighbours, and
    sources without any tokens are taken once. Rows that repeat are documents like others. An empty table gives an empty
    result. The orders are hashes of the row, so that a run repeated gives the same. A source's stream is summed up in
    buckets of about ``bucket_docs`` documents, so no task has to hold a source. The sums of buckets are broadcast up to
    ``broadcast_rows`` rows, which are counted; beyond that their join shuffles.
    """
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document"),
        F.col(source_col).alias("source"),
        F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)).alias("tokens"),
    )
    counts = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = mixture(counts, entropy, most_passes, budget)
    quotas = plan.weights.select(
        F.col("source").alias("s"), F.col("tokens").alias("of"), "quota",
        F.greatest(F.ceil("docs") / F.lit(float(bucket_docs)), F.lit(1.0)).alias("buckets"),
        F.when(F.col("tokens") > 0, F.ceil(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)).cast("int").alias("passes"),
    )
    drawn = rows.join(quotas, rows.source.eqNullSafe(quotas.s)).select(
        "document", "source", "tokens", "of", "quota", "buckets",
        F.explode(F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1))).alias("pass"),
    )
    drawn = drawn.withColumn("h", F.xxhash64(F.lit(seed), "pass", "document"))
    # hashes are even over their range, so ranges of them are even parts of the order
    drawn = drawn.withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.ceil("buckets")).cast("int"))
    sums = drawn.groupBy("source", "pass", "bucket").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("s"), F.col("pass").alias("p"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
    )
    # a row for each ten thousand documents; joined without a second shuffle of the documents while they are few
    sums = tables.small(tables.staged(sums, "sums"), broadcast_rows)
    within = Window.partitionBy("source", "pass", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    same = placed.source.eqNullSafe(sums.s) & (placed["pass"] == sums.p) & (placed.bucket == sums.b)
    placed = placed.join(sums, same)
    at = F.col("pass") * F.col("of") + F.col("start") + F.col("inner")
    blocks = max(1, math.ceil(plan.budget / block_tokens))
    part = F.when(F.col("quota") > 0, at / F.col("quota")).otherwise(F.lit(0.0))
    taken = (at < F.col("quota")) | (F.col("of") == 0) | ((F.col("tokens") == 0) & (at <= F.col("quota")))
    return placed.where(taken).select(
        "document", "source", "pass",
        F.least(F.floor(part * blocks), F.lit(blocks - 1)).cast("long").alias("block"),
        F.xxhash64("h").alias("position"),
    )
