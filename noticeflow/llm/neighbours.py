"""Approximate nearest neighbours: a graph built by NN-descent with Spark joins, and greedy search in it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm import tables


@dataclass(frozen=True)
class Index:
    """``nodes`` (node, vec): a row per distinct vector; ``members`` (node, id, vector): the smallest ids of each;
    ``graph`` (node, nbr): links in both directions; ``entries``: nodes where every search starts."""

    nodes: DataFrame
    members: DataFrame
    graph: DataFrame
    entries: DataFrame


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles) of the rows that take part: no null, zero or non-finite vectors, and all of one length.

    That length is the most frequent one; of several, the smallest. Rows with a null id take no part.
    """
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (size.n if size else 0))


def build(
    vectors: DataFrame,
    id_col: str,
    vector_col: str,
    keep: int,
    degree: int = 36,
    sample: int = 24,
    rounds: int = 10,
    stop: float = 0.015,
    group: int = 2048,
    entries: int = 512,
    seed: int = 42,
    broadcast_bytes: int = 64 << 20,
) -> Index:
    """Neighbour graph of all usable vectors by cosine.

    Equal vectors are one node, so that any number of copies costs one; ``keep`` of their ids, the smallest, are held
    as members. Every node begins with its nearest in two random groups of about ``group``; with one, the groups would
    never meet. In a round each node introduces its neighbours
    to each other (``degree`` of its own, ``sample`` of those that point to it; pairs of old ones are left out), and
    each takes over what is nearer. It ends after ``rounds``, or when less than ``stop`` of the links changed. The
    samples are the method's own; recall is measured in the tests. Vectors are compared as normalised halves, and
    broadcast to the joins if all of them take at most ``broadcast_bytes``; otherwise the joins shuffle.
    """
    ranked = Window.partitionBy("k1", "k2").orderBy("id")
    keys = [F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit("v"), "vector").alias("k2")]
    members = (
        usable(vectors, id_col, vector_col)
        .select(*keys, "id", "vector")
        .withColumn("r", F.row_number().over(ranked))
        .where(F.col("r") <= keep)
        .withColumn("node", F.first("id").over(ranked))
    )
    members = tables.staged(members, "members")
    nodes = members.where("r = 1").select("node", "vector").mapInArrow(_halves, "node long, vec binary")
    nodes = tables.staged(nodes, "nodes")
    n, size = nodes.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("vec") + 32), F.lit(0))).first()
    light = F.broadcast if size <= broadcast_bytes else (lambda df: df)
    groups = max(1, round(n / group))
    drawn = F.explode(F.array(*[
        F.struct(F.lit(i).alias("draw"), F.pmod(F.xxhash64(F.lit(seed + i), "node"), F.lit(groups)).alias("g")) for i in (0, 1)
    ]))
    start = nodes.select("node", "vec", drawn.alias("d")).groupBy("d").agg(
        F.collect_list(F.struct("node", F.lit(True).alias("new"), F.lit(-2.0).alias("worst"), "vec")).alias("near")
    )
    links = _nearest(start.mapInArrow(_introduce(degree, degree), _LINK), degree)
    for _ in range(rounds):
        links = tables.staged(links, "links")
        if links.where("new").count() <= stop * n * degree:
            break
        links = _nearest(_round(links, nodes, degree, sample, light).unionByName(links.withColumn("new", F.lit(False))), degree)
    links = tables.staged(links, "links")
    both = links.select("node", "nbr").union(_reverse(links, degree).select("node", "nbr")).distinct()
    first = nodes.orderBy(F.xxhash64(F.lit(seed - 1), "node")).limit(entries)
    return Index(light(nodes), members, tables.staged(both, "graph"), tables.staged(first, "entries"))


_LINK = "node long, nbr long, score float, new boolean"


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            vectors = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
            # scaled first: squares of very large or very small numbers leave the range
            vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
            vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype("<f2")
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([v.tobytes() for v in vectors], pa.binary())], ["node", "vec"]
            )


def _reverse(links: DataFrame, sample: int) -> DataFrame:
    turned = links.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "new")
    order = Window.partitionBy("node").orderBy(F.desc("new"), F.xxhash64("nbr", "node"))
    return turned.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).drop("r")


def _round(links: DataFrame, nodes: DataFrame, degree: int, sample: int, light: Callable[[DataFrame], DataFrame]) -> DataFrame:
    near = links.select("node", "nbr", "new").union(_reverse(links, sample).select("node", "nbr", "new"))
    near = near.groupBy("node", "nbr").agg(F.max("new").alias("new"))
    worst = links.groupBy("node").agg(
        F.when(F.count("*") >= degree, F.min("score")).otherwise(F.lit(-2.0)).cast("double").alias("worst")
    )
    known = light(nodes.join(worst, "node", "left").withColumnRenamed("node", "nbr"))
    # dealt by node first: a join that broadcasts keeps it, and vectors are not shuffled then
    known = near.repartition("node").join(known, "nbr")
    met = known.groupBy("node").agg(F.collect_list(F.struct(
        F.col("nbr").alias("node"), "new", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "vec"
    )).alias("near"))
    return met.mapInArrow(_introduce(degree), _LINK)


def _introduce(degree: int, most: int = 6):
    """New links among the vectors of each row: to the ``most`` nearest of the others, as far as they are an improvement."""

    def introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                near = batch.column("near")[i].values
                n = len(near)
                if n < 2:
                    continue
                ids = near.field("node").to_numpy()
                new = near.field("new").to_numpy(zero_copy_only=False)
                worst = near.field("worst").to_numpy()
                vec = np.frombuffer(b"".join(near.field("vec").to_pylist()), dtype="<f2").reshape(n, -1).astype(np.float32)
                scores = vec @ vec.T
                scores[~(new[:, None] | new[None, :]) | np.eye(n, dtype=bool) | (scores <= worst[:, None])] = -3
                top = min(most, n - 1)
                at = np.argpartition(-scores, top - 1, axis=1)[:, :top]
                best = np.take_along_axis(scores, at, axis=1)
                row, col = np.nonzero(best > -3)
                out.append((ids[row], ids[at[row, col]], best[row, col]))
            if out:
                node, nbr, score = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array(nbr), pa.array(score), pa.array(np.ones(len(node), dtype=bool))],
                    ["node", "nbr", "score", "new"],
                )

    return introduce


def _nearest(links: DataFrame, degree: int) -> DataFrame:
    """The best ``degree`` links of each node; a link that was known is not new."""
    once = links.repartition("node").groupBy("node", "nbr").agg(F.max("score").alias("score"), F.min("new").alias("new"))
    order = Window.partitionBy("node").orderBy(F.desc("score"), "nbr")
    return once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= degree).drop("r")


def search(
    index: Index, queries: DataFrame, id_col: str, vector_col: str, k: int, beam: int = 128, step: int = 16
) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` nearest rows found for each query, without the row of the query's own id.

    Greedy search: from the best of the entries, and from the query's own node if its vector is indexed, each round
    looks at the neighbours of the ``step`` best nodes not looked at, and keeps the ``beam`` best nodes of each query,
    until all of those have been looked at. The result is ordered by cosine in double precision on the given vectors,
    ties to the smaller id. The index must hold ``keep > k`` members for each node. Queries that can't take part give
    no rows; a query finds fewer than ``k`` rows only if there are no more.
    """
    asked = usable(queries, id_col, vector_col).select(F.col("id").alias("query"), "vector")
    asked = tables.staged(asked, "queries")
    halves = asked.select(F.col("query").alias("node"), "vector").mapInArrow(_halves, "node long, vec binary")
    halves = tables.staged(halves.select(F.col("node").alias("query"), F.col("vec").alias("query_vec")), "queries")
    points = [(r.node, bytes(r.vec)) for r in index.entries.collect()]  # a fixed number
    first = halves.mapInArrow(_enter(points, step), _STATE)
    own = asked.join(index.members.select("vector", "node").distinct(), "vector").join(index.nodes, "node")
    own = own.join(halves, "query").select("query", "node", "query_vec", "vec").mapInArrow(_score, _STATE)
    state = first.union(own).groupBy("query", "node").agg(F.max("score").alias("score"), F.max("done").alias("done"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    while True:
        state = tables.staged(state.withColumn("r", F.row_number().over(best)).where(F.col("r") <= beam).drop("r"), "search")
        open_ = state.where("NOT done").withColumn("r", F.row_number().over(best)).where(F.col("r") <= step)
        open_ = tables.staged(open_.select("query", "node"), "open")
        if open_.isEmpty():
            break
        seen = open_.join(index.graph, "node").select("query", F.col("nbr").alias("node")).distinct()
        fresh = seen.join(state, ["query", "node"], "left_anti")
        fresh = fresh.join(index.nodes, "node").join(halves, "query").select("query", "node", "query_vec", "vec")
        marked = state.join(open_.withColumn("now", F.lit(True)), ["query", "node"], "left").select(
            "query", "node", "score", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done")
        )
        state = marked.union(fresh.mapInArrow(_score, _STATE))
    found = state.select("query", "node").join(index.members.select("node", "id", "vector"), "node").where("query <> id")
    found = found.join(asked.select("query", F.col("vector").alias("query_vector")), "query")
    exact = found.select("query", "id", "vector", "query_vector").mapInArrow(_cosine, "query long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", "id", "score"
    )


_STATE = "query long, node long, score float, done boolean"


def _state(query, node, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query), pa.array(node), pa.array(score, pa.float32()), pa.array(np.zeros(len(node), dtype=bool))],
        ["query", "node", "score", "done"],
    )


def _stack(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), dtype="<f2").reshape(len(values), -1).astype(np.float32)


def _enter(points: list[tuple[int, bytes]], step: int):
    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = np.array([node for node, _ in points], dtype=np.int64)
        for batch in batches:
            if batch.num_rows and len(nodes):
                vec = np.frombuffer(b"".join(v for _, v in points), dtype="<f2").reshape(len(nodes), -1).astype(np.float32)
                queries = _stack(batch.column("query_vec"))
                if queries.shape[1] != vec.shape[1]:
                    continue  # vectors of another length than the index
                scores = queries @ vec.T
                top = np.argsort(-scores, axis=1, kind="stable")[:, :step]
                ids = np.repeat(batch.column("query").to_numpy(), top.shape[1])
                yield _state(ids, nodes[top].ravel(), np.take_along_axis(scores, top, axis=1).ravel())

    return enter


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            scores = np.einsum("ij,ij->i", _stack(batch.column("query_vec")), _stack(batch.column("vec")))
            yield _state(batch.column("query").to_numpy(), batch.column("node").to_numpy(), scores)


def _cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (
                batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("query_vector", "vector")
            )
            scores = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query"), batch.column("id"), pa.array(scores)], ["query", "id", "score"]
            )
