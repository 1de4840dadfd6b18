"""Groups of texts whose sets of word shingles resemble each other: candidates by SimHash and MinHash, every link checked exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from noticeflow.llm import components, simhash, tables, words

#: Keys of a set, and the minima in each; the minima whose lowest bits make the sketch.
BANDS, IN_BAND, SKETCH = 24, 4, 128
#: Bits of two sketches that must agree. At a similarity of 0.8, 115 of 128 do on average; this is five deviations below.
LEAST_AGREEING = 98
#: Bits of a set's parities. A shingle flips one, so two sets differ in at least as many shingles as their parities in bits.
PARITIES = 2048
#: Members of a key that one task compares; a larger group is dealt out in blocks of half as many.
GROUP = 1024
#: Texts that are signed at once.
PART = 1024
LOWERED = np.frombuffer(words.LOWER_TABLE, dtype=np.uint8)

_random = np.random.default_rng(42)
_MULTIPLIERS = _random.integers(0, 1 << 64, SKETCH, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 64, SKETCH, dtype=np.uint64)
_SEEDS = _random.integers(0, 1 << 64, BANDS, dtype=np.uint64)


def groups(documents: DataFrame, id_col: str, text_col: str, shingle: int = 5, percent: int = 80, group: int = GROUP) -> DataFrame:
    """``id_col, _t1, _t2`` (:func:`words.text_keys`) and ``root``, which is equal for texts reachable over links.

    Two texts are linked if the sets of their shingles (``shingle`` words, as in :mod:`simhash`; a shorter text is one
    shingle) have a Jaccard similarity of at least ``percent`` hundredths. Texts without words, or null, are one group.

    First come the near copies of :func:`simhash.near_copies` on the same shingles, each checked against the least of its
    component. Further candidates share one of 24 keys of four MinHash minima, which two sets of similarity 0.8 miss with a
    chance of 3 in a million, agree in the sketch, and differ in so few parities that they may be similar enough. The shingle
    sets of every candidate pair are compared. A round takes as many pairs of a key as would connect its members; a
    last one takes all pairs that are not connected by then.
    """
    rows = documents.select(id_col, *words.text_keys(text_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = StructType(
        [
            StructField(id_col, rows.schema[id_col].dataType),
            *(StructField(c, LongType()) for c in ("_t1", "_t2", "node", "s1", "s2")),
            StructField("n", IntegerType()),
            StructField("parities", BinaryType()),
            StructField("keys", ArrayType(LongType())),
        ]
    )
    signed = tables.staged(rows.mapInArrow(words.freeing(_sign(shingle, id_col)), schema), "signatures")
    distinct = signed.where(F.size("keys") > 0).dropDuplicates(["node"])
    copies = simhash.near_copies(_with_nodes(documents, text_col, shingle), "node", "text", shingle)
    near = copies.select(F.col("component_id").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    near = tables.staged(near, "near")
    links = _checked(documents, near, text_col, shingle, percent)
    roots = tables.staged(components.connected(links), "roots")
    keyed = distinct.select(F.explode("keys").alias("key"), "node")
    keyed = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "key")
    keyed = tables.staged(keyed.join(distinct.drop(id_col, "_t1", "_t2", "keys"), "node"), "keyed")
    tried = near
    for every in (False, True):
        placed = keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        more = tables.staged(_candidates(placed, group, percent, every).join(tried, ["a", "b"], "left_anti"), "candidates")
        if not more.isEmpty():
            links, tried = links.union(_checked(documents, more, text_col, shingle, percent)), tried.union(more)
            roots = tables.staged(components.connected(links), "roots")
    named = signed.select(id_col, "_t1", "_t2", "node").join(roots, "node", "left")
    return named.select(id_col, "_t1", "_t2", F.coalesce("root", "node").alias("root"))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; empty for a text without words."""
    data = LOWERED[np.frombuffer(text, dtype=np.uint8)]
    starts, ends = words.spans(data)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    return np.unique(words.rolling(words.word_hashes(data, starts, ends), min(shingle, len(starts))))


def _node(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 42)).view(np.int64))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash function."""
    out = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        out = np.minimum(out, (shingles[at : at + 2048] * _MULTIPLIERS[:, None] + _SHIFTS[:, None]).min(axis=1))
    return out


def parities(shingles: np.ndarray) -> bytes:
    """For each share of the hash space whether the set has an odd number of members there."""
    counts = np.bincount((shingles & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _with_nodes(documents: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, text) of every row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            nodes = [_node(shingle_set(text.as_buffer(), shingle)) for text in texts]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), texts], ["node", "text"])

    return documents.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(words.freeing(apply), "node long, text string")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from (batch.slice(at, PART) for at in range(0, batch.num_rows, PART))


def _sign(shingle: int, id_col: str):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            nodes, least, sizes, odd = [], [], [], []
            for text in batch.column("_text"):
                shingles = shingle_set(text.as_buffer(), shingle)
                nodes.append(_node(shingles))
                sizes.append(len(shingles))
                odd.append(parities(shingles))
                least.append(minima(shingles))
            least = np.array(least, dtype=np.uint64).reshape(-1, SKETCH)
            bits = np.packbits((words.mix(least) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little")
            sketch = bits.view("<i8").reshape(-1, 2)
            bands = least[:, : BANDS * IN_BAND].reshape(-1, BANDS, IN_BAND)
            keys = np.broadcast_to(_SEEDS, bands.shape[:2])
            for i in range(IN_BAND):
                keys = words.mix(keys + bands[:, :, i])
            known = np.array(sizes, dtype=np.int64) > 0
            offsets = np.concatenate([[0], np.cumsum(np.where(known, BANDS, 0))]).astype(np.int32)
            flat = keys[known].reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col), batch.column("_t1"), batch.column("_t2"), pa.array(nodes, pa.int64()),
                    pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), pa.array(sizes, pa.int32()), pa.array(odd, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                [id_col, "_t1", "_t2", "node", "s1", "s2", "n", "parities", "keys"],
            )

    return sign


def _candidates(keyed: DataFrame, group: int, percent: int, every: bool) -> DataFrame:
    """Distinct pairs a < b of members of a key with different roots: all of them, or enough to connect the key's members."""
    blocks = F.ceil(F.col("members") * 2 / group).cast("int")
    cut = keyed.withColumn("parts", F.when(F.col("members") > group, blocks).otherwise(1))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "s1", "s2", "n", "parities", "root"
    )
    return dealt.groupBy("key", "x", "y").applyInArrow(_pairs(percent, every), "a long, b long").distinct()


def _pairs(percent: int, every: bool):
    def pairs(table: pa.Table) -> pa.Table:
        # in one order for all keys, so that they name the same pairs
        table = table.sort_by("node")
        own, node, s1, s2, n, root = (table.column(c).to_numpy() for c in ("own", "node", "s1", "s2", "n", "root"))
        sketch = np.stack([s1, s2], axis=1).view(np.uint64)
        odd = np.frombuffer(b"".join(table.column("parities").to_pylist()), dtype=np.uint64).reshape(len(node), -1)
        crossing = len(np.unique(own)) > 1
        a, b = [], []

        def near(one: int, rest: np.ndarray) -> np.ndarray:
            differing = np.bitwise_count(sketch[rest] ^ sketch[one]).sum(axis=1, dtype=np.int64)
            got = np.flatnonzero((differing <= SKETCH - LEAST_AGREEING) & (root[rest] != root[one]))
            least = np.bitwise_count(odd[rest[got]] ^ odd[one]).sum(axis=1, dtype=np.int64)
            hit = np.zeros(len(rest), dtype=bool)
            # sets that differ in so many shingles are not similar enough
            hit[got[(100 + percent) * least <= (100 - percent) * (n[rest[got]].astype(np.int64) + n[one])]] = True
            return hit

        def found(one: int, got: np.ndarray) -> None:
            a.append(np.minimum(node[got], node[one]))
            b.append(np.maximum(node[got], node[one]))

        rest = np.arange(len(node))
        if every:
            while len(rest) > 1:
                one, rest = rest[0], rest[1:]
                # pairs of one block are found where it meets itself
                found(one, rest[near(one, rest) & ((own[rest] != own[one]) | (not crossing))])
        while len(rest) > 1:
            reached, rest = [rest[0]], rest[1:]
            while reached and len(rest):
                one = reached.pop()
                hit = near(one, rest)
                found(one, rest[hit])
                reached.extend(rest[hit])
                rest = rest[~hit]
        none = np.empty(0, dtype=np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return pairs


def _checked(documents: DataFrame, pairs: DataFrame, text_col: str, shingle: int, percent: int) -> DataFrame:
    """The pairs that are similar enough by their whole shingle sets."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = documents.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sets = texts.mapInArrow(words.freeing(_sets(shingle)), "node long, shingles binary")
    sets = tables.staged(sets.join(tables.small(wanted, 500_000), "node", "left_semi").dropDuplicates(["node"]), "shingles")
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set")
    return tables.staged(both.mapInArrow(words.freeing(_similar(percent)), "a long, b long"), "links")


def _sets(shingle: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # some texts at a time, as a set takes more than its text
            for at in range(0, batch.num_rows, 256):
                found = [shingle_set(text.as_buffer(), shingle) for text in batch.column("_text").slice(at, 256)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(map(_node, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
                    ["node", "shingles"],
                )

    return apply


def _similar(percent: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for one, other in zip(batch.column("a_set"), batch.column("b_set"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (one, other))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return apply
