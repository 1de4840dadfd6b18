"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm import tables


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node reachable, for all nodes of the edges (a, b).

    Alternates two steps until nothing changes: each node ties its larger neighbours to its smallest one, then its
    smaller ones. The number of rounds grows with the logarithm of the longest path. Every round is written to the
    shared folder. Rows with a null end are ignored. A node in very many edges is only grouped by minimum and joined.
    """
    links = tables.staged(_oriented(edges.where("a IS NOT NULL AND b IS NOT NULL")), "edges")
    state = _state(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = tables.staged(_oriented(large), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        links = tables.staged(_oriented(small), "edges")
        now = _state(links)
        if now == state:
            # stars: every node is tied to its root
            roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        state = now


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
