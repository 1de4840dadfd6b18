"""Near copies of documents by SimHash fingerprints, which Golay codewords bring together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from noticeflow.llm import components, golay, tables, words

#: Shingles whose bits are counted at once, fingerprints whose keys are made at once.
BLOCK = 1 << 15
#: Members of a key that one task compares; a larger group is dealt out in blocks of half as many.
GROUP = 4096
SEED = 42


def near_copies(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, group: int = GROUP
) -> DataFrame:
    """``id_col, fingerprint`` (long) and ``component_id``: the smallest id reachable over links of at most four bits.

    Shingles are ``shingle`` words (runs without ASCII white space, A-Z lower-cased), a shorter text is one shingle, a
    text without words, or null, has fingerprint zero. A bit of the fingerprint is set if it is set in over half of the
    XXH64 hashes. Equal fingerprints are compared once, so exact copies cost nothing. Fingerprints that share a key of
    :func:`golay.keys` are compared; each task returns only as many links as it needs to connect what is linked.

    A row per input row; repeated rows stay. Null ids never name a component unless a component has no other. An empty
    table gives an empty result. Further columns are ignored.
    """
    prints = tables.staged(fingerprints(documents, id_col, text_col, shingle), "fingerprints")
    distinct = tables.staged(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "distinct")
    roots = components.connected(links(distinct.select("fingerprint"), group))
    placed = distinct.join(roots, distinct.fingerprint == roots.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    placed = tables.staged(placed, "placed")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(id_col, "fingerprint", "component_id")


def fingerprints(documents: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """(id, fingerprint) per row; the 64 bits as a signed number."""
    rows = documents.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = StructType([StructField(id_col, rows.schema[id_col].dataType), StructField("fingerprint", LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(text.as_py().encode(), shingle) for text in batch.column("text")]
            out = np.array(values, dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, pa.int64())], schema.names)

    return rows.mapInArrow(apply, schema)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    tokens = text.translate(words.LOWER_TABLE).split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(tokens))
    first, last = starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    totals = np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), BLOCK):
        block = [digest(line[s:e], SEED) for s, e in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(block, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * totals > len(first), bitorder="little").view("<u8")[0])


def links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints at up to four bits, enough of them to connect all that are linked."""
    spark = distinct.sparkSession
    keyed = distinct.mapInArrow(_keys, "key long, fingerprint long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartition(parts, "key").sortWithinPartitions("key")
    found = tables.staged(ordered.mapInArrow(_compare(group), "large boolean, a long, b long"), "links")
    # Groups beyond the size of a task: every pair of their blocks meets in a task of its own.
    large = found.where("large").select(F.col("a").alias("key"), F.col("b").alias("fingerprint"))
    blocks = large.groupBy("key").agg(F.ceil(F.count("*") * 2 / group).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("n")).cast("int")
    dealt = large.join(blocks, "key").withColumn("own", own).select(
        "key", "fingerprint", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"), "own"
    )
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fingerprint")
    met = dealt.groupBy("key", "x", "y").applyInArrow(_meet, "a long, b long")
    return found.where("NOT large").select("a", "b").union(met)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("fingerprint").to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(values), 2048):
            block = values[at : at + 2048]
            rows, keys = golay.keys(block.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(block[rows])], ["key", "fingerprint"])


class _Forest:
    """Links seen by a task, as far as they connect something new."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def _root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def add(self, pairs: np.ndarray) -> list[tuple[int, int]]:
        new = []
        for a, b in pairs.tolist():
            x, y = self._root(a), self._root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                new.append((a, b))
        return new


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= golay.TOLERANCE


def _within(members: np.ndarray) -> np.ndarray:
    """Linked pairs that connect all that is linked in a group. Each member is compared with those not reached yet."""
    out = [np.empty((0, 2), dtype=np.int64)]
    rest = members
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            one = reached.pop()
            near = _near(rest, one)
            if near.any():
                got, rest = rest[near], rest[~near]
                out.append(np.stack([np.full(len(got), one), got], axis=1))
                reached.extend(got)
    return np.concatenate(out)


def _compare(group: int):
    """Compare the fingerprints of each key, from rows in the order of keys; groups over ``group`` are handed on."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        held_key, held, handed = None, np.empty(0, dtype=np.int64), False

        def linked(keys: np.ndarray, prints: np.ndarray):
            """Whole groups: small ones by shifts against themselves, larger ones each by itself."""
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            sizes = np.diff(edges)
            for i in np.flatnonzero(sizes > 16):
                yield _within(prints[edges[i] : edges[i + 1]])
            small = np.repeat(sizes <= 16, sizes)
            keys, prints = keys[small], prints[small]
            for shift in range(1, 16):
                i = np.flatnonzero(keys[shift:] == keys[:-shift])
                if not len(i):
                    break
                i = i[_near(prints[i], prints[i + shift])]
                yield np.stack([prints[i], prints[i + shift]], axis=1)

        def rows(large: bool, a, b) -> pa.RecordBatch:
            arrays = [pa.array([large] * len(a), pa.bool_()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["large", "a", "b"])

        def settle(keys: np.ndarray, prints: np.ndarray):
            for pairs in linked(keys, prints):
                new = forest.add(pairs)
                if new:
                    yield rows(False, *zip(*new, strict=True))

        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            prints = batch.column("fingerprint").to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            if held_key is not None:
                same = int(np.searchsorted(keys, held_key, side="right"))
                held, keys, prints = np.concatenate([held, prints[:same]]), keys[same:], prints[same:]
                if handed or len(held) > group:
                    yield rows(True, np.full(len(held), held_key), held)
                    held, handed = held[:0], True
                if not len(keys):
                    continue
                if not handed:
                    yield from settle(np.full(len(held), held_key), held)
            # the last key of a batch may go on in the next one
            tail = int(np.searchsorted(keys, keys[-1]))
            edges = np.flatnonzero(np.concatenate([[True], keys[1:tail] != keys[: max(tail - 1, 0)]])) if tail else []
            sizes = np.diff(np.append(edges, tail)) if tail else np.empty(0, dtype=np.int64)
            big = np.repeat(sizes > group, sizes) if tail else np.empty(0, dtype=bool)
            if big.any():
                yield rows(True, keys[:tail][big], prints[:tail][big])
            if tail:
                yield from settle(keys[:tail][~big], prints[:tail][~big])
            held_key, held, handed = keys[-1], prints[tail:], False
        if held_key is not None and not handed:
            if len(held) > group:
                yield rows(True, np.full(len(held), held_key), held)
            else:
                yield from settle(np.full(len(held), held_key), held)

    return compare


def _meet(table: pa.Table) -> pa.Table:
    members = np.unique(table.column("fingerprint").to_numpy())
    new = _Forest().add(_within(members))
    a, b = zip(*new, strict=True) if new else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
