"""The prefix trie of conversations: one row per distinct sequence of first turns.

Conversations are dealt by ranges of their sequences. A task sorts its range as a padded matrix of turn ids; column by
column, a mask of changes marks where nodes start, and sums over the marked segments give the figures of every depth.
Only nodes on the paths of a range's first and last conversation can go on in another range; these are recombined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm import tables

#: Turns that one task sorts, and columns of the matrix that it holds at once.
SHARD_TURNS = 1 << 17
BLOCK = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()

_SHARD = (
    "shard int, first boolean, last boolean, n1 long, n2 long, p1 long, p2 long, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, before long, until long, ends_sha256 string, ids string"
)


def numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id, pos`` (from 1), ``t1, t2`` (128 bits that stand for role and text) and ``size`` (code points of the text).

    Turns of a conversation are ordered by turn, null first, then by role and text; null roles and texts are empty ones.
    Repeated rows are turns of their own. Rows without a conversation id belong to no conversation and are left out.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))),
    ).where("conv_id IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    return rows.select(
        "conv_id",
        place.alias("pos"),
        F.xxhash64("role", "text").alias("t1"),
        F.xxhash64(F.length("role"), "text", "role").alias("t2"),
        F.length("text").cast("long").alias("size"),
    )


def sequences(numbered_turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv_id`` and ``turns``, its turns in order. A conversation is one row of some 24 bytes a turn."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "t1", "t2", "size")))
    return numbered_turns.groupBy(F.col(conv_col).alias("conv_id")).agg(
        F.transform(rows, lambda t: F.struct(t["t1"], t["t2"], t["size"])).alias("turns")
    )


def with_heads(conversations: DataFrame, source: Column, head: Column, most: int) -> DataFrame:
    """Each conversation with its first ``head`` turns (``most`` at most) replaced by those of conversation ``source``.

    A shorter source gives all its turns, an absent one none; the conversation's own turns after its first ``head`` stay.
    """
    rows = tables.staged(conversations.select("conv_id", "turns", source.alias("source"), head.cast("int").alias("head")), "sequences")
    wanted = rows.select(F.col("source").alias("conv_id")).distinct()
    heads = rows.join(wanted, "conv_id", "left_semi").select(F.col("conv_id").alias("source"), F.slice("turns", 1, most).alias("first"))
    joined = rows.join(tables.small(heads, 200_000), "source", "left")
    own = F.expr("slice(turns, head + 1, greatest(size(turns), 1))")
    first = F.expr("CASE WHEN first IS NULL THEN slice(turns, 1, 0) ELSE slice(first, 1, head) END")
    return joined.select("conv_id", F.concat(first, own).alias("turns"))


def nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per node of the trie of ``conversations`` (``conv_id``, unique; ``turns``, see :func:`sequences`).

    A node is a distinct sequence of first turns, from the empty one of depth 0; its members are the conversations that
    start with it. Columns, long: ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes in the subtree, itself included), ``saved_tokens``
    (over the subtree, members but one times the code points of a node's last text), and ``ends_sha256`` (SHA-256 of the
    ids of members that end here, ascending, comma-joined).

    No conversations give no rows; one without turns is a member of the root alone. Conversations alike in all turns are
    dealt by their ids, so any number of them is many ranges; their ids are hashed in order, a range at a time.
    """
    key = F.flatten(F.transform("turns", lambda t: F.array(t["t1"], t["t2"])))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    rows = tables.staged(rows, "keys")
    total = rows.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_turns))
    parts = tables.staged(rows.repartitionByRange(shards, "key", "conv_id").mapInArrow(_shard, _SHARD), "nodes")
    edge = parts.where("n1 IS NOT NULL")
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    whole = edge.select("n1", "n2", "p1", "p2", "depth", "conv_id", *figures).union(_corrections(edge))
    whole = whole.groupBy("n1", "n2").agg(
        *(F.max(c).alias(c) for c in ("p1", "p2", "depth")), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in figures)
    )
    pieces = edge.where("ids IS NOT NULL").select("n1", "n2", "shard", "ids").repartition("n1", "n2").sortWithinPartitions("n1", "n2", "shard")
    ends = pieces.mapInArrow(_joined_ends, "n1 long, n2 long, ends_sha256 string")
    whole = tables.staged(whole.join(ends, ["n1", "n2"], "left"), "edge")
    parents = tables.small(whole.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent")), 500_000)
    inner = parts.where("n1 IS NULL").withColumn("known", F.col("parent_conv_id"))
    both = inner.select("p1", "p2", "known", "depth", "conv_id", *figures, "ends_sha256").unionByName(
        whole.select("p1", "p2", F.lit(None).cast("long").alias("known"), "depth", "conv_id", *figures, "ends_sha256")
    )
    return both.join(parents, ["p1", "p2"], "left").select(
        "conv_id", "depth", F.coalesce("known", "parent").alias("parent_conv_id"), *figures, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )


def _corrections(edge: DataFrame) -> DataFrame:
    """What is counted twice where a range goes on with the nodes that the one before it ended with.

    The nodes that both have are a path. Down this path, each node has a child too many, each text is paid once too often,
    and if the earlier range ended with the last of these nodes, it took it for a leaf.
    """
    shards = edge.select("shard").distinct().withColumn("at", F.row_number().over(Window.orderBy("shard")))
    at = edge.join(F.broadcast(shards), "shard")
    opened = at.where("first").select("at", "n1", "n2", "depth", "before", "until")
    closed = at.where("last").select((F.col("at") + 1).alias("at"), "n1", "n2", "depth")
    bottom = closed.groupBy("at").agg(F.max("depth").alias("bottom"))
    both = opened.join(closed.drop("depth"), ["at", "n1", "n2"])
    deepest = both.groupBy("at").agg(F.max("depth").alias("deepest"), F.max("until").alias("paid")).join(bottom, "at")
    none = F.lit(None).cast("long")
    return both.join(deepest, "at").select(
        "n1", "n2", none.alias("p1"), none.alias("p2"), "depth", none.alias("conv_id"), F.lit(0).cast("long").alias("n_convs"),
        F.when(F.col("depth") < F.col("deepest"), -1).otherwise(0).cast("long").alias("n_children"),
        F.when(F.col("deepest") == F.col("bottom"), -1).otherwise(0).cast("long").alias("n_leaves"),
        (F.col("paid") - F.col("before")).alias("saved_tokens"),
    )


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which come in order."""
    node, digest = None, None

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()])], ["n1", "n2", "ends_sha256"]
        )

    for batch in batches:
        for n1, n2, ids in zip(*(batch.column(c) for c in ("n1", "n2", "ids")), strict=True):
            now = (n1.as_py(), n2.as_py())
            if now != node:
                if node:
                    yield done()
                node, digest = now, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_buffer())
    if node:
        yield done()


def sorted_rows(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """The order of rows by their sequences of ids, shorter ones first, then by ``ties``.

    The padded matrix is sorted from its last block of columns to the first; a block holds only rows that reach it.
    """
    order = np.argsort(ties, kind="stable")
    for at in range((int(sizes.max(initial=0)) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        deep = sizes[order] > at
        rows = order[deep]
        if not len(rows):
            continue
        columns = np.arange(at, min(at + BLOCK, int(sizes[rows].max())))
        place = np.minimum(starts[rows][:, None] + columns, len(ids) - 1)
        matrix = np.where(columns < sizes[rows][:, None], ids[place], 0)
        order = np.concatenate([order[~deep], rows[np.lexsort(matrix.T[::-1])]])
    return order


def levels(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, weights: np.ndarray, conv: np.ndarray) -> Iterator[dict]:
    """Of rows in order, for each depth: nodes with parent, first row, members, least id and weight, and the rows that end."""
    rows = np.arange(len(conv))
    change = np.zeros(len(conv), dtype=bool)
    change[0] = True
    node = np.zeros(len(conv), dtype=np.int64)
    root = np.zeros(1, dtype=np.int64)
    yield {
        "parent": root, "row": root, "n": np.array([len(conv)]), "conv": conv.min(keepdims=True), "weight": root,
        "ends": rows[sizes == 0], "end_of": node[sizes == 0],
    }
    for depth in range(1, int(sizes.max()) + 1):
        place = np.minimum(starts[rows] + depth - 1, len(ids) - 1)
        column = np.where(sizes[rows] >= depth, ids[place], 0)
        change[1:] |= column[1:] != column[:-1]
        inside = column > 0
        rows, change, parent = rows[inside], change[inside], node[inside]
        at = np.flatnonzero(change)
        node = np.cumsum(change) - 1
        ended = sizes[rows] == depth
        yield {
            "parent": parent[at], "row": rows[at], "n": np.diff(np.append(at, len(rows))), "conv": np.minimum.reduceat(conv[rows], at),
            "weight": weights[starts[rows[at]] + depth - 1], "ends": rows[ended], "end_of": node[ended],
        }


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    conv = table.column("conv_id").to_numpy()
    keys, weights = (table.column(c).chunk(0) for c in ("key", "sizes"))
    pairs = keys.flatten().to_numpy().reshape(-1, 2)
    weights = weights.flatten().to_numpy()
    sizes = np.diff(keys.offsets.to_numpy()).astype(np.int64) // 2
    starts = np.cumsum(sizes) - sizes
    ids = _dense(pairs)
    order = sorted_rows(ids, starts, sizes, conv)
    conv, sizes, starts = conv[order], sizes[order], starts[order]
    depths = list(levels(ids, starts, sizes, weights, conv))
    for upper, lower in zip(depths, depths[1:], strict=False):
        upper["children"] = np.bincount(lower["parent"], minlength=len(upper["n"]))
    depths[-1]["children"] = np.zeros(len(depths[-1]["n"]), dtype=np.int64)
    for level in depths:
        level["leaves"] = (level["children"] == 0).astype(np.int64)
        level["saved"] = (level["n"] - 1) * level["weight"]
    for upper, lower in zip(depths[-2::-1], depths[:0:-1], strict=True):
        for c in ("leaves", "saved"):
            np.add.at(upper[c], lower["parent"], lower[c])
    shard = TaskContext.get().partitionId()
    paths = [_path(pairs, weights, int(starts[i]), int(sizes[i])) for i in (0, -1)]
    above: dict[int, tuple[int, int]] = {}
    for depth, level in enumerate(depths):
        count = len(level["n"])
        edge = {i: path[depth] for i, path, reached in ((0, paths[0], sizes[0]), (count - 1, paths[1], sizes[-1])) if reached >= depth}
        ended, first = np.unique(level["end_of"], return_index=True)
        texts = {int(i): ",".join(map(str, conv[r].tolist())) for i, r in zip(ended, np.split(level["ends"], first[1:]), strict=bool(len(ended)))}
        yield _level(shard, depth, level, edge, above, texts, depths[depth - 1]["conv"] if depth else None, sizes[0] >= depth, sizes[-1] >= depth)
        above = edge


def _dense(pairs: np.ndarray) -> np.ndarray:
    """Ids from 1 in the order of the pairs."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    ordered = pairs[order]
    out = np.empty(len(pairs), dtype=np.int64)
    out[order] = np.cumsum(np.any(np.diff(ordered, axis=0, prepend=ordered[:1]) != 0, axis=1)) + 1
    return out


def _path(pairs: np.ndarray, weights: np.ndarray, start: int, size: int) -> list[tuple[int, int, int, int]]:
    """By depth, 128 bits that stand for the row's first turns, and the weights above and down to this depth."""
    digest, total = xxhash.xxh3_128(seed=42), 0
    out = [(*_halves(digest), 0, 0)]
    for i in range(start, start + size):
        digest.update(pairs[i].tobytes())
        weight = int(weights[i])
        out.append((*_halves(digest), total, total + weight))
        total += weight
    return out


def _halves(digest) -> tuple[int, int]:
    raw = digest.digest()
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def _level(shard, depth, level, edge, above, texts, parent_conv, on_first, on_last) -> pa.RecordBatch:
    count = len(level["n"])

    def sparse(values: dict, kind) -> pa.Array:
        return pa.array([values.get(i) for i in range(count)], kind)

    parent = level["parent"].tolist() if depth else [None] * count
    from_edge = [above.get(p) for p in parent]
    inner = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items() if i not in edge}
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard] * count, pa.int32()),
            pa.array([on_first and i == 0 for i in range(count)], pa.bool_()),
            pa.array([on_last and i == count - 1 for i in range(count)], pa.bool_()),
            *(sparse({i: e[k] for i, e in edge.items()}, pa.int64()) for k in (0, 1)),
            *(pa.array([e[k] if e else None for e in from_edge], pa.int64()) for k in (0, 1)),
            pa.array([depth] * count, pa.int64()),
            pa.array(level["conv"], pa.int64()),
            pa.array([None if e or p is None else int(parent_conv[p]) for p, e in zip(parent, from_edge, strict=True)], pa.int64()),
            *(pa.array(level[c], pa.int64()) for c in ("n", "children", "leaves", "saved")),
            *(sparse({i: e[k] for i, e in edge.items()}, pa.int64()) for k in (2, 3)),
            sparse(inner, pa.string()),
            sparse({i: t for i, t in texts.items() if i in edge}, pa.string()),
        ],
        [c.split()[0] for c in _SHARD.split(", ")],
    )
