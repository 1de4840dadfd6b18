"""Join of texts by the Jaccard similarity of their sets of word shingles, over prefix trees of globally ordered sets.

All shingles have one order, rare ones first. Two sets that are similar enough share a shingle among the first few of
either (their prefixes), and the first one they share is where both their remaining shingles begin to run together. The
sets that hold a shingle in their prefixes are stored in a trie of what follows it; the trie is joined with itself, one
count of differing shingles standing for all sets below a node, and a branch is left once the count and the remaining
lengths exceed what the similarity allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from noticeflow.llm import chunks, components, tables, words

#: Text that is hashed at once, and text whose shingles one counting task holds.
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
#: Shingles behind the shared one that the trie holds.
DEPTH = 24
#: Shares of the hash space in which a set's shingles are counted: sets differ by at least what their counts differ.
SHARES = 128
#: Sets of a shingle that one task joins; more are dealt out in blocks of half as many.
GROUP = 4096
#: Rows whose tries are joined at once, and pairs of nodes that are looked at in one step.
ROWS, FRONTIER = 1 << 14, 1 << 17
#: Rounds that link only neighbours in the order of the trie.
CHAINS = 2
LOWERED = np.frombuffer(words.LOWER_TABLE, dtype=np.uint8)
END = np.uint64(0xFFFFFFFFFFFFFFFF)


def join(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90,
    group: int = GROUP, depth: int = DEPTH, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``id_col, n_shingles`` and ``component_id``, the smallest id reachable over links, for every row.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a text's set holds its distinct runs of
    ``shingle`` words, or all its words as one if they are fewer. Two texts are linked if their sets have a Jaccard
    similarity of at least ``percent`` hundredths. Null texts and texts without words have no shingles and no links.
    Repeated rows and equal sets are linked; null ids are kept and count only where a component has no other id. An empty
    table gives an empty result; other columns are ignored. A very long text is one row of its own.

    Every link is decided on whole sets. Shingles are 64-bit hashes; equal sets are one set from the start. A first few
    rounds link neighbours in the trie's order and the nearest sets of two components; the last one takes all pairs that
    are not connected by then.
    """
    rows = chunks.chunked(documents, id_col, text_col, CHUNK_BYTES)
    buckets = chunks.bucket_count(documents, text_col, bucket_bytes)
    asked = rows.select("chunk", "texts").mapInArrow(words.freeing(_ask(shingle, buckets)), "chunk long, bucket int, hashes binary, counts binary")
    answered = asked.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, counts binary")
    answers = answered.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    joined = rows.join(answers, "chunk", "left").select("ids", "texts", "answers")
    schema = StructType(
        [StructField(id_col, rows.schema["ids"].dataType.elementType), *(StructField(c, LongType()) for c in ("n", "n1", "n2"))]
    ).add("counts", "binary").add("path", "binary").add("rest", "binary")
    signed = tables.staged(joined.mapInArrow(words.freeing(_sign(shingle, percent, buckets, schema.names)), schema), "sets")
    open_ = signed.where("n1 IS NOT NULL")
    # a set's own number, and its shingles from one of its rows
    sets = open_.where("path IS NOT NULL").select("n1", "n2", "n", "counts", "path", "rest").dropDuplicates(["n1", "n2"])
    sets = tables.staged(sets.withColumn("node", F.monotonically_increasing_id()), "distinct")
    roots = _linked(sets, percent, group, depth)
    least = open_.groupBy("n1", "n2").agg(F.min(id_col).alias("least"))
    named = sets.select("n1", "n2", "node").join(least, ["n1", "n2"]).join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("n1", "n2", "component_id")
    count = F.col("n").alias("n_shingles")
    return (
        open_.join(named, ["n1", "n2"]).select(id_col, count, "component_id")
        .union(signed.where("n1 IS NULL").select(id_col, count, F.col(id_col).alias("component_id")))
    )


def _linked(sets: DataFrame, percent: int, group: int, depth: int) -> DataFrame:
    """(node, root) of the sets that are linked."""
    keyed = sets.select("node", "n", "counts", "path").mapInArrow(words.freeing(_keys(percent, depth)), _KEYED)
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    keyed = tables.staged(keyed.join(shared, "key"), "keyed")
    links, roots = None, sets.select("node", F.col("node").alias("root")).limit(0)
    for turn in range(CHAINS + 2):
        placed = keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if turn == 0:
            # the shingles that most sets share stand for whole groups
            place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("size").desc(), "key"))
            placed = placed.withColumn("place", place).where("place <= 2").drop("place")
        if turn < CHAINS:
            pairs = _chained(placed, percent)
        else:
            pairs = _joined(placed, percent, group, depth, turn == CHAINS)
        found = _checked(tables.staged(pairs.distinct(), "candidates"), sets, percent)
        new = not found.isEmpty()
        if new:
            links = found if links is None else links.union(found)
            roots = tables.staged(components.connected(links), "roots")
    return roots


def _chained(placed: DataFrame, percent: int) -> DataFrame:
    """Neighbours in the order of (key, path) with different roots, over ranges of any size."""
    ranged = placed.repartitionByRange("key", "path", "node").sortWithinPartitions("key", "path", "node")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, node, weight, size, root = (batch.column(c).to_numpy() for c in ("key", "node", "weight", "n", "root"))
            near = np.flatnonzero((key[1:] == key[:-1]) & (root[1:] != root[:-1]) & (weight[1:] + weight[:-1] <= 0))
            apart = _apart(_counts(batch.column("counts")), near, near + 1)
            near = near[(100 + percent) * apart <= (100 - percent) * (size[near] + size[near + 1])]
            yield _pairs(node[near], node[near + 1])

    return ranged.mapInArrow(words.freeing(chain), "a long, b long")


def _counts(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SHARES)


def _apart(counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shingles that two sets don't share, at least: the sum of what their counts (modulo 256) differ."""
    out = np.empty(len(a), dtype=np.int64)
    for at in range(0, len(a), ROWS):
        part = slice(at, at + ROWS)
        over = counts[a[part]] - counts[b[part]]
        out[part] = np.minimum(over, -over).sum(axis=1, dtype=np.int64)
    return out


def _joined(placed: DataFrame, percent: int, group: int, depth: int, nearest: bool) -> DataFrame:
    """Pairs that the tries don't rule out, of sets with different roots: all, or the nearest one of two roots in a trie."""
    open_ = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
    blocks = F.when(F.col("size") > group, F.ceil(F.col("size") * 2 / group)).otherwise(1).cast("int")
    cut = placed.join(open_, "key", "left_semi").withColumn("parts", blocks)
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "n", "weight", "left", "root", "counts", "path")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(words.freeing(_tries(percent, depth, nearest)), "a long, b long")


_KEYED = "key long, node long, n long, weight long, left long, counts binary, path binary"


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar enough by their whole sets."""
    left, right = (
        sets.select(F.col("node").alias(c), F.struct("n", "path", "rest").alias(f"set_{c}")) for c in "ab"
    )
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                same = len(np.intersect1d(_full(x), _full(y), assume_unique=True))
                kept.append((100 + percent) * same >= percent * (x["n"].as_py() + y["n"].as_py()))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return tables.staged(both.mapInArrow(words.freeing(similar), "a long, b long"), "links")


def _full(row: pa.StructScalar) -> np.ndarray:
    """Hashes of a set: their order keys hold the upper 56 bits, ``rest`` the other 8."""
    keys = np.frombuffer(row["path"].as_buffer(), dtype=np.uint64)
    return (keys << np.uint64(8)) | np.frombuffer(row["rest"].as_buffer(), dtype=np.uint8)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the sets of texts: each one's distinct hashes, ascending."""
    raw, offsets = chunks.text_bytes(texts)
    data = LOWERED[raw]
    starts, ends = words.spans(data)
    hashes = words.word_hashes(data, starts, ends)
    edges = np.searchsorted(starts, offsets)
    runs = words.rolling(hashes, shingle)
    out = []
    for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if last - first >= shingle:
            found = np.sort(runs[first : last - shingle + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        else:
            out.append(words.rolling(hashes[first:last], last - first) if last > first else hashes[:0])
    return np.concatenate([hashes[:0], *out]), np.cumsum([0, *map(len, out)])


def _ask(shingle: int, buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = chunks.bucket_bounds(buckets)
        for batch, i in chunks.chunk_rows(batches):
            hashes, _ = shingle_sets(batch.column("texts")[i].values, shingle)
            distinct, counts = np.unique(hashes, return_counts=True)
            counts = np.minimum(counts, 255).astype(np.uint8)
            cuts = chunks.bucket_cuts(distinct, bounds)
            used = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("chunk")[i].as_py()] * len(used), pa.int64()),
                    pa.array(used, pa.int32()),
                    pa.array([chunks.pack_sorted(distinct[cuts[b] : cuts[b + 1]]) for b in used], pa.binary()),
                    pa.array([counts[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()),
                ],
                ["chunk", "bucket", "hashes", "counts"],
            )

    return ask


def _answer(group: pa.Table) -> pa.Table:
    """How many texts hold each hash, 255 standing for all above."""
    hashes = [chunks.unpack_sorted(x.as_py()) for x in group.column("hashes")]
    counts = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint8) for x in group.column("counts")])
    together = np.concatenate(hashes)
    order = np.argsort(together, kind="stable")
    ordered = together[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
    sums = np.minimum(np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new)), 255).astype(np.uint8)
    total = np.empty(len(together), dtype=np.uint8)
    total[order] = sums[np.cumsum(new) - 1]
    parts = np.split(total, np.cumsum([len(h) for h in hashes])[:-1])
    return pa.table(
        {
            "chunk": group.column("chunk"),
            "bucket": group.column("bucket"),
            "counts": pa.array([p.tobytes() for p in parts], pa.binary()),
        }
    )


def _sign(shingle: int, percent: int, buckets: int, names: list[str]):
    """Sets of the texts, with those shingles that other texts have too, in the global order.

    A set with too few of these can't be linked and gets no name (``n1``, ``n2``) and no shingles.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i in chunks.chunk_rows(batches):
            hashes, offsets = shingle_sets(batch.column("texts")[i].values, shingle)
            distinct = np.unique(hashes)
            answers = batch.column("answers")[i].as_py() or []
            counts = np.concatenate([np.frombuffer(a["counts"], dtype=np.uint8) for a in sorted(answers, key=lambda a: a["bucket"])] or [np.empty(0, np.uint8)])
            common = counts[np.searchsorted(distinct, hashes)]
            shared = np.concatenate([[0], np.cumsum(common > 1)])
            n = np.diff(offsets)
            open_ = (n > 0) & (100 * (shared[offsets[1:]] - shared[offsets[:-1]]) >= percent * n)
            seen, found = set(), []
            for at, to, able in zip(offsets[:-1].tolist(), offsets[1:].tolist(), open_.tolist(), strict=True):
                if not able:
                    found.append((None,) * 5)
                    continue
                digest = xxhash.xxh3_128_digest(hashes[at:to], seed=42)
                name = int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)
                if name in seen:
                    found.append((*name, None, None, None))
                    continue
                seen.add(name)
                kept = np.flatnonzero(common[at:to] > 1) + at
                key = (common[kept].astype(np.uint64) << np.uint64(56)) | (hashes[kept] >> np.uint64(8))
                order = np.argsort(key, kind="stable")
                shares = np.bincount((hashes[at:to] >> np.uint64(57)).astype(np.int64), minlength=SHARES).astype(np.uint8)
                found.append((*name, shares.tobytes(), key[order].tobytes(), hashes[kept][order].astype(np.uint8).tobytes()))
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 2 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids")[i].values, pa.array(n, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names
            )

    return sign


def _keys(percent: int, depth: int):
    """A row per shingle of a set's prefix, with what follows it.

    ``weight`` is what the differing shingles known by then and the size of the set put on the scale: two sets are similar
    enough if ``(100 + percent)`` times all differing shingles is at most ``(100 - percent)`` times both sizes. ``left``
    is the number of shingles behind the shared one.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, counts, path in zip(*(batch.column(c) for c in ("node", "n", "counts", "path")), strict=True):
                node, n, counts = node.as_py(), n.as_py(), counts.as_py()
                path = np.frombuffer(path.as_buffer(), dtype=np.uint64)
                prefix = len(path) + percent * n // -100 + 1
                place = np.arange(prefix)
                padded = np.concatenate([path, np.full(depth, END)])
                # bytes in the order of the numbers
                behind = np.lib.stride_tricks.sliding_window_view(padded[1:], depth)[:prefix].astype(">u8")
                behind = np.ascontiguousarray(behind).view(f"V{8 * depth}").reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(path[:prefix].view(np.int64)),
                        pa.array(np.full(prefix, node, dtype=np.int64)),
                        pa.array(np.full(prefix, n, dtype=np.int64)),
                        pa.array((100 + percent) * (place + n - len(path)) - (100 - percent) * n),
                        pa.array(len(path) - 1 - place),
                        pa.array([counts] * prefix, pa.binary()),
                        pa.array([x.tobytes() for x in behind], pa.binary()),
                    ],
                    [c.split()[0] for c in _KEYED.split(", ")],
                )

    return keys


def _tries(percent: int, depth: int, nearest: bool):
    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                groups = _group_numbers(table)
                cut = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
                if cut:
                    yield from _trie_pairs(table.slice(0, cut), groups[:cut], percent, depth, nearest)
                held, rows = table.slice(cut).to_batches(), len(groups) - cut
        if rows:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from _trie_pairs(table, _group_numbers(table), percent, depth, nearest)

    return tries


def _group_numbers(table: pa.Table) -> np.ndarray:
    columns = [table.column(c).to_numpy() for c in ("key", "x", "y")]
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.concatenate([[0], np.cumsum(new)])


def _trie_pairs(table: pa.Table, groups: np.ndarray, percent: int, depth: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    node, size, weight, left, root, own = (table.column(c).to_numpy() for c in ("node", "n", "weight", "left", "root", "own"))
    crossing = table.column("x").to_numpy() != table.column("y").to_numpy()
    # within one block all pairs count; between two blocks those of unlike blocks
    side = np.where(crossing, own, -1)
    paths = np.frombuffer(b"".join(table.column("path").to_pylist()), dtype=">u8").reshape(-1, depth).astype(np.uint64)
    order = np.lexsort((*paths.T[::-1], groups))
    node, size, weight, left, root, side, groups = (c[order] for c in (node, size, weight, left, root, side, groups))
    counts = _counts(table.column("counts"))[order]
    held: list[tuple] = []
    for a, b in Trie(paths[order], groups, weight, left, root, side).self_join(percent):
        apart = _apart(counts, a, b)
        near = (100 + percent) * apart <= (100 - percent) * (size[a] + size[b])
        a, b, apart = a[near], b[near], apart[near]
        if not nearest:
            yield _pairs(node[a], node[b])
            continue
        held.append(_nearest(root, groups, a, b, apart))
        if sum(len(x[0]) for x in held) > FRONTIER:
            held = [_nearest(root, groups, *(np.concatenate(c) for c in zip(*held, strict=True)))]
    if held:
        a, b, _ = _nearest(root, groups, *(np.concatenate(c) for c in zip(*held, strict=True)))
        yield _pairs(node[a], node[b])


def _nearest(root: np.ndarray, groups: np.ndarray, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> tuple:
    """Of the pairs of two roots in a group, the one least apart."""
    x, y, g = np.minimum(root[a], root[b]), np.maximum(root[a], root[b]), groups[a]
    order = np.lexsort((apart, y, x, g))
    x, y, g = x[order], y[order], g[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (g[1:] != g[:-1])
    kept = order[new]
    return a[kept], b[kept], apart[kept]


class Trie:
    """Tries of sorted paths, one below each group, as arrays over their nodes, level by level.

    Of the rows below a node it keeps the least weight, the range of what is left, and the ranges of roots and sides.
    """

    def __init__(self, paths: np.ndarray, groups: np.ndarray, weight, left, root, side):
        rows, depth = paths.shape
        change = np.concatenate([[True], groups[1:] != groups[:-1]])
        starts, tokens = [np.flatnonzero(change)], [np.zeros(int(change.sum()), dtype=np.uint64)]
        for d in range(depth):
            change[1:] |= paths[1:, d] != paths[:-1, d]
            starts.append(np.flatnonzero(change))
            tokens.append(paths[starts[-1], d])
        sizes = [len(s) for s in starts]
        base = np.cumsum([0, *sizes])
        self.roots = sizes[0]
        self.level = np.repeat(np.arange(depth + 1), sizes)
        self.token = np.concatenate(tokens)
        self.first = np.concatenate(starts)
        self.last = np.concatenate([np.append(s[1:], rows) for s in starts])
        # children of a node are neighbours on the next level
        self.low, self.high = np.zeros(base[-1], dtype=np.int64), np.zeros(base[-1], dtype=np.int64)
        for d in range(depth):
            upper = slice(base[d], base[d + 1])
            self.low[upper] = base[d + 1] + np.searchsorted(starts[d + 1], self.first[upper])
            self.high[upper] = base[d + 1] + np.searchsorted(starts[d + 1], self.last[upper])
        self.weight = np.concatenate([np.minimum.reduceat(weight, s) for s in starts])
        self.least_left, self.most_left = (np.concatenate([f.reduceat(left, s) for s in starts]) for f in (np.minimum, np.maximum))
        self.least_root, self.most_root = (np.concatenate([f.reduceat(root, s) for s in starts]) for f in (np.minimum, np.maximum))
        self.least_side, self.most_side = (np.concatenate([f.reduceat(side, s) for s in starts]) for f in (np.minimum, np.maximum))
        self.rows = {"weight": weight, "left": left, "root": root, "side": side}

    def _open(self, u: np.ndarray, v: np.ndarray, differing: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes may have similar sets below them that are not connected.

        ``u`` and ``v`` have been compared down to, but without, their own shingles.
        """
        left_u = self.least_left[u] - self.level[u], self.most_left[u] - self.level[u]
        left_v = self.least_left[v] - self.level[v], self.most_left[v] - self.level[v]
        gap = np.maximum(0, np.maximum(left_u[0] - left_v[1], left_v[0] - left_u[1]))
        near = (100 + percent) * (differing + gap) + self.weight[u] + self.weight[v] <= 0
        one_root = (self.least_root[u] == self.most_root[v]) & (self.most_root[u] == self.least_root[v])
        one_side = (self.least_side[u] >= 0) & (self.least_side[u] == self.most_side[v]) & (self.most_side[u] == self.least_side[v])
        return near & ~one_root & ~one_side

    def self_join(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one group that may be similar enough, each pair once, some at a time."""
        roots = np.arange(self.roots)
        stack = [(roots, roots, np.zeros(self.roots, dtype=np.int64))]
        while stack:
            u, v, differing = stack.pop()
            if len(u) > FRONTIER:
                half = len(u) // 2
                stack += [(u[:half], v[:half], differing[:half]), (u[half:], v[half:], differing[half:])]
                continue
            x, y = self.token[u], self.token[v]
            # a path is over at its last level, or where both sets have ended
            over = ((x <= y) & (self.high[u] == self.low[u])) | ((y <= x) & (self.high[v] == self.low[v])) | ((x == END) & (y == END))
            yield from self._row_pairs(u[over], v[over], differing[over] + (x != y)[over], percent)
            u, v, differing, x, y = (c[~over] for c in (u, v, differing, x, y))
            down_u, down_v = x <= y, y <= x
            n_u = np.where(down_u, self.high[u] - self.low[u], 1)
            n_v = np.where(down_v, self.high[v] - self.low[v], 1)
            first_u, first_v = np.where(down_u, self.low[u], u), np.where(down_v, self.low[v], v)
            i = np.repeat(np.arange(len(u)), n_u * n_v)
            k = np.arange(len(i)) - np.repeat(np.cumsum(n_u * n_v) - n_u * n_v, n_u * n_v)
            next_u, next_v = first_u[i] + k // n_v[i], first_v[i] + k % n_v[i]
            more = (differing + (x != y))[i]
            # a node with itself: each pair of children once
            kept = (u[i] != v[i]) | (next_u <= next_v)
            next_u, next_v, more = next_u[kept], next_v[kept], more[kept]
            open_ = self._open(next_u, next_v, more, percent)
            if open_.any():
                stack.append((next_u[open_], next_v[open_], more[open_]))

    def _row_pairs(self, u: np.ndarray, v: np.ndarray, differing: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        sizes = (self.last[u] - self.first[u]) * (self.last[v] - self.first[v])
        ends = np.cumsum(sizes)
        while at < len(u):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * FRONTIER, side="right")))
            part = slice(at, to)
            i = np.repeat(np.arange(at, to), sizes[part])
            k = np.arange(len(i)) - np.repeat(ends[part] - sizes[part] - (ends[at - 1] if at else 0), sizes[part])
            wide = (self.last[v] - self.first[v])[i]
            a, b = self.first[u][i] + k // wide, self.first[v][i] + k % wide
            rows = self.rows
            # a set stands in a group once; of a node with itself, each pair of rows once
            kept = ((u[i] != v[i]) | (a < b)) & (rows["root"][a] != rows["root"][b])
            kept &= (rows["side"][a] < 0) | (rows["side"][a] != rows["side"][b])
            kept &= (100 + percent) * differing[i] + rows["weight"][a] + rows["weight"][b] <= 0
            if kept.any():
                yield a[kept], b[kept]
            at = to
