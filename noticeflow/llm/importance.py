"""Importance resampling towards a target by hashed word n-grams, with a head-tail vocabulary.

A feature's bucket is the CRC-32 of its bytes modulo the number of buckets. CRC-32 of joined pieces follows from the
pieces' own values and lengths, so a word's value is looked up (the head) or computed from its bytes (the tail), and
that of a run of words is combined from those of its words. The head only saves work: every bucket is exact either way.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from noticeflow.llm import chunks, tables, words

#: Words and pairs of at least this share of all are the head, so there are at most so many of them.
HEAD_WORDS, HEAD_PAIRS = 1 << 16, 1 << 17
#: Text and words that are worked on at once.
PIECE_BYTES = 1 << 20
COUNTED = 1 << 20

#: Bytes that part words: everything in ASCII but digits and lower-case letters, after lower-casing.
GAP = np.zeros(256, dtype=bool)
GAP[:128] = True
GAP[ord("0") : ord("9") + 1] = GAP[ord("a") : ord("z") + 1] = False
LOWERED = np.frombuffer(words.LOWER_TABLE, dtype=np.uint8)

_CRC_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC_TABLE = (_CRC_TABLE >> np.uint32(1)) ^ np.where(_CRC_TABLE & 1, np.uint32(0xEDB88320), np.uint32(0))
_SPACE_CRC = np.uint32(zlib.crc32(b" "))
#: Words up to this many bytes may be in the head, and shifts by so many bytes are one table lookup.
SHORT, NEAR = 16, 64


def _zeros_tables(most: int) -> np.ndarray:
    """[n][k][b]: what the CRC with byte k equal to b becomes when n zero bytes follow."""
    out = np.empty((most + 1, 4, 256), dtype=np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(most):
        out[n + 1] = _CRC_TABLE[out[n] & 0xFF] ^ (out[n] >> np.uint32(8))
    return out


def _doubled(table: np.ndarray) -> np.ndarray:
    """The table for twice as many zero bytes."""
    return table[0][table & 0xFF] ^ table[1][(table >> 8) & 0xFF] ^ table[2][(table >> 16) & 0xFF] ^ table[3][table >> 24]


_ZEROS = _zeros_tables(NEAR)
_FLAT_ZEROS = _ZEROS.reshape(-1)
_DOUBLES = [_ZEROS[NEAR]]


def _shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs after ``size`` zero bytes, which with an exclusive or appends text of that length."""
    near = np.minimum(size, NEAR - 1) * 1024
    out = (
        _FLAT_ZEROS[near + (crc & 0xFF)]
        ^ _FLAT_ZEROS[near + 256 + ((crc >> 8) & 0xFF)]
        ^ _FLAT_ZEROS[near + 512 + ((crc >> 16) & 0xFF)]
        ^ _FLAT_ZEROS[near + 768 + (crc >> 24)]
    )
    far = np.flatnonzero(size >= NEAR)
    if len(far):
        out[far] = _far(crc[far], size[far])
    return out


def _far(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same for any length, by powers of two."""
    out = _shifted(crc, size % NEAR)
    left, k = size // NEAR, 0
    while left.any():
        if k == len(_DOUBLES):
            _DOUBLES.append(_doubled(_DOUBLES[-1]))
        table, odd = _DOUBLES[k], np.flatnonzero(left & 1)
        x = out[odd]
        out[odd] = table[0][x & 0xFF] ^ table[1][(x >> 8) & 0xFF] ^ table[2][(x >> 16) & 0xFF] ^ table[3][x >> 24]
        left, k = left >> 1, k + 1
    return out


def _joined(crc: np.ndarray, word_crc: np.ndarray, word_size: np.ndarray) -> np.ndarray:
    """CRC of what ``crc`` stands for, a space and a word."""
    after_space = _CRC_TABLE[crc & 0xFF] ^ (crc >> np.uint32(8))
    return _shifted(after_space ^ _SPACE_CRC, word_size) ^ word_crc


def _direct(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of words from their bytes: byte by byte over all short words at once, long ones by the library."""
    out = np.empty(len(starts), dtype=np.uint32)
    short = np.flatnonzero(sizes <= NEAR)
    short = short[np.argsort(sizes[short], kind="stable")[::-1]]
    at, ends = starts[short], np.cumsum(np.bincount(sizes[short], minlength=NEAR + 1)[::-1])[::-1]
    state = np.full(len(short), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(int(sizes[short[0]]) if len(short) else 0):
        open_ = int(ends[k + 1])  # words longer than k bytes come first
        state[:open_] = _CRC_TABLE[(state[:open_] ^ data[at[:open_] + k]) & 0xFF] ^ (state[:open_] >> np.uint32(8))
    out[short] = ~state
    for i in np.flatnonzero(sizes > NEAR):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]])
    return out


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def _packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each word as two numbers. ``data`` has 16 more bytes than its words."""
    eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    return eight[starts] & _MASKS[np.minimum(sizes, 8)], eight[starts + 8] & _MASKS[np.clip(sizes - 8, 0, 8)]


def _unpacked(low: np.ndarray, high: np.ndarray) -> list[bytes]:
    return [row.tobytes().rstrip(b"\0") for row in np.stack([low, high], axis=1).astype("<u8")]


def _slots(low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    return (words.mix(low ^ words.mix(high + np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Head:
    """Frequent words with their CRC states and frequent pairs with their buckets, in tables of fixed size.

    A slot holds one word or pair, the more frequent of those that meet there; what is not found is computed.
    """

    bits: int
    low: np.ndarray
    high: np.ndarray
    crc: np.ndarray
    pair_bits: int
    pairs: np.ndarray
    pair_crc: np.ndarray

    def word(self, low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, found)"""
        slot = _slots(low, high, self.bits)
        return slot, (self.low[slot] == low) & (self.high[slot] == high) & (sizes <= SHORT)

    def pair(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, slot, found) of pairs of word slots"""
        key = (first.astype(np.uint64) << np.uint64(self.bits)) | second.astype(np.uint64)
        slot = _slots(key, key, self.pair_bits)
        return key, slot, self.pairs[slot] == key


def _table(bits: int, slot: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Columns by slot; of several rows for a slot the first one stays."""
    out = []
    for column in columns:
        values = np.full(1 << bits, np.iinfo(column.dtype).max, dtype=column.dtype)
        values[slot[::-1]] = column[::-1]
        out.append(values)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]):
    """Words of some texts at a time: (batch, first row, rows, bytes, starts, sizes, row of each word).

    The bytes are lower-cased and end in 16 zero bytes. A text of any length is one piece.
    """
    for batch in batches:
        texts = batch.column("_text")
        offsets = chunks.text_offsets(texts)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, side="right")) - 1)
            raw, inner = chunks.text_bytes(texts.slice(at, to - at))
            data = np.concatenate([LOWERED[raw], np.zeros(SHORT, dtype=np.uint8)])
            starts, ends = words.spans(data[: len(raw)], GAP)
            yield batch, at, to - at, data, starts, ends - starts, np.searchsorted(inner[1:], starts, side="right")
            at = to


def _texts(documents: DataFrame, text_col: str) -> DataFrame:
    return documents.select(chunks.terminated(F.col(text_col)).alias("_text"))


def _sums(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Counts added up by distinct keys."""
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys]) if len(order) else False
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(counts[order], at) if len(at) else counts


class _Counter:
    """Counts of a task, handed on whenever they are many."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.held = names, [], 0

    def add(self, *keys: np.ndarray) -> None:
        if len(keys[0]):
            got, n = _sums(list(keys), np.ones(len(keys[0]), dtype=np.int64))
            self.parts.append((got, n))
            self.held += len(n)

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.parts and self.held >= least:
            keys = [np.concatenate(x) for x in zip(*(k for k, _ in self.parts), strict=True)]
            keys, n = _sums(keys, np.concatenate([n for _, n in self.parts]))
            self.parts, self.held = [], 0
            yield pa.RecordBatch.from_arrays([*(pa.array(k.view(np.int64)) for k in keys), pa.array(n)], self.names)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter, longer = _Counter(["low", "high", "n"]), 0
    for *_, data, starts, sizes, _row in _pieces(batches):
        short = sizes <= SHORT
        longer += int((~short).sum())
        counter.add(*_packed(data, starts[short], sizes[short]))
        yield from counter.batches(COUNTED)
    yield from counter.batches(1)
    # words too long for the head count towards the total
    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([longer])], ["low", "high", "n"])


def _count_pairs(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, counter, other = shared.value, _Counter(["key", "n"]), 0
        for *_, data, starts, sizes, row in _pieces(batches):
            slot, found = head.word(*_packed(data, starts, sizes), sizes)
            near = row[1:] == row[:-1]
            known = near & found[1:] & found[:-1]
            other += int(near.sum() - known.sum())
            key, _, _ = head.pair(slot[:-1][known], slot[1:][known])
            counter.add(key)
            yield from counter.batches(COUNTED)
        yield from counter.batches(1)
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([other])], ["key", "n"])

    return count


def _frequent(counted: DataFrame, keys: list[str], most: int) -> tuple[list[np.ndarray], DataFrame]:
    """Keys with at least one ``most``-th of all counts, the most frequent first; there are at most ``most`` of them."""
    sums = tables.staged(counted.groupBy(*keys).agg(F.sum("n").alias("n")), "frequent")
    total = sums.agg(F.sum("n")).first()[0] or 0
    least = -(-total // most)
    rows = sums.where((F.col("n") >= least) & (F.col(keys[-1]) >= 0 if keys == ["key"] else F.col("low") != 0))
    got = sorted((tuple(r) for r in rows.collect()), key=lambda r: (-r[-1], r))
    return [np.array([r[i] for r in got], dtype=np.int64).view(np.uint64) for i in range(len(keys))]


def learn_head(documents: DataFrame, text_col: str = "text", head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS) -> Head:
    """The frequent words (up to 16 bytes) and pairs of frequent words, counted over all texts."""
    texts = _texts(documents, text_col)
    low, high = _frequent(texts.mapInArrow(_count_words, "low long, high long, n long"), ["low", "high"], head_words)
    bits = max(4, (4 * head_words - 1).bit_length())
    crc = np.array([zlib.crc32(w) for w in _unpacked(low, high)], dtype=np.uint32)
    pair_bits = max(4, (4 * head_pairs - 1).bit_length())
    none = np.full(1 << pair_bits, np.iinfo(np.uint64).max, dtype=np.uint64)
    head = Head(bits, *_table(bits, _slots(low, high, bits), low, high, crc), pair_bits, none, np.zeros(1 << pair_bits, dtype=np.uint32))
    context = documents.sparkSession.sparkContext
    pairs = texts.mapInArrow(_count_pairs(context.broadcast(head)), "key long, n long")
    (key,) = _frequent(pairs, ["key"], head_pairs)
    first, second = (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    size = np.array([len(w) for w in _unpacked(head.low[second], head.high[second])], dtype=np.int64)
    pair_crc = _joined(head.crc[first], head.crc[second], size)
    head.pairs, head.pair_crc = _table(pair_bits, _slots(key, key, pair_bits), key, pair_crc)
    return head


def features(head: Head, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, CRC-32) of all runs of one, two and three words; runs don't cross rows."""
    slot, found = head.word(*_packed(data, starts, sizes), sizes)
    crc = head.crc[slot]
    tail = np.flatnonzero(~found)
    crc[tail] = _direct(data, starts[tail], sizes[tail])
    yield row, crc
    if len(row) < 2:
        return
    near = row[1:] == row[:-1]
    at = np.flatnonzero(near)
    known = found[at] & found[at + 1]
    _, pair_slot, hit = head.pair(slot[at], slot[at + 1])
    pair = head.pair_crc[pair_slot]
    rest = np.flatnonzero(~(known & hit))
    pair[rest] = _joined(crc[at[rest]], crc[at[rest] + 1], sizes[at[rest] + 1])
    yield row[at], pair
    third = np.flatnonzero(near[1:] & near[:-1])
    if len(third):
        # pairs stand in the order of their first words
        place = np.cumsum(near) - 1
        yield row[third], _joined(pair[place[third]], crc[third + 2], sizes[third + 2])


def _bucket_totals(shared, buckets: int):
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for *_, data, starts, sizes, row in _pieces(batches):
            for _, crc in features(shared.value, data, starts, sizes, row):
                sums += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used])], ["bucket", "n"])

    return total


def bucket_totals(documents: DataFrame, shared, text_col: str = "text", buckets: int = 10_000) -> np.ndarray:
    """Features of all texts by bucket: a row per bucket and task is summed; the result has a row per bucket."""
    counted = _texts(documents, text_col).mapInArrow(_bucket_totals(shared, buckets), "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's smoothed share of a bucket over the source's), in doubles."""
    n, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)],
        dtype=np.int64,
    )


def weigh(
    documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10_000
) -> DataFrame:
    """``id_col, n_words, n_features`` and ``weight`` of every document.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; features are all runs of one to three
    words joined by a space. The weight of a document is the sum of its features' gains. Null and empty texts weigh 0;
    repeated rows are separate documents; null ids are kept; other columns are ignored. A task holds one very long text at
    a time. With an empty target the smoothed shares still give every bucket a gain; empty documents give no rows.
    """
    context = documents.sparkSession.sparkContext
    shared = context.broadcast(learn_head(documents, text_col))
    source = bucket_totals(documents, shared, text_col, buckets)
    gain = context.broadcast(gains(source, bucket_totals(target, shared, target_col, buckets)))
    rows = documents.select(F.col(id_col), chunks.terminated(F.col(text_col)).alias("_text"))
    schema = StructType([rows.schema[id_col], *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, n, data, starts, sizes, row in _pieces(batches):
            count = np.zeros(n, dtype=np.int64)
            weight = np.zeros(n, dtype=np.int64)
            for of, crc in features(shared.value, data, starts, sizes, row):
                count += np.bincount(of, minlength=n)
                # rows ascend, so sums of a row's gains are differences of running sums
                sums = np.concatenate([[0], np.cumsum(gain.value[crc % np.uint32(buckets)])])
                edges = np.searchsorted(of, np.arange(n + 1))
                weight += sums[edges[1:]] - sums[edges[:-1]]
            columns = [batch.column(0).slice(at, n), *(pa.array(x) for x in (np.bincount(row, minlength=n), count, weight))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(apply, schema)


def draw(weighed: DataFrame, noise: Column, order: Column, eligible: Column, percent: int = 5) -> DataFrame:
    """All rows with ``score`` (weight and noise) and ``rank``: 1, 2, 3... for those drawn, null for the others.

    Drawn are the ``percent`` hundredths of the eligible rows, rounded down, with the highest scores. Ties go to the
    smaller ``order``, null first; rows alike in both stand in any order. Rows are dealt by ranges of score, order and
    their own number, so that no number of equal ones meets in one task.
    """
    given = F.struct(*[weighed[c] for c in weighed.columns])
    scored = weighed.select(
        given.alias("row"), (F.col("weight") + noise).alias("score"), order.alias("order"), F.coalesce(eligible, F.lit(False)).alias("open")
    )
    scored = tables.staged(scored.withColumn("number", F.monotonically_increasing_id()), "scored")
    keys = [F.col("score").desc(), F.col("order").asc_nulls_first(), F.col("number")]
    parts = int(weighed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scored.where("open").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = tables.staged(ranged.select("row", "score", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ranged")
    # a row for each partition
    sizes = ranged.groupBy("part").agg(F.min("at").alias("least"), F.count("*").alias("n")).orderBy("part").collect()
    before, shifts = 0, []
    for part, least, n in sizes:
        shifts.append((part, before - least + 1))
        before += n
    shift = weighed.sparkSession.createDataFrame(shifts, "part int, shift long")
    rank = F.col("at") + F.col("shift")
    ranked = ranged.join(F.broadcast(shift), "part")
    ranked = ranked.select("row.*", "score", F.when(rank <= percent * before // 100, rank).alias("rank"))
    return ranked.union(scored.where("NOT open").select("row.*", "score", F.lit(None).cast("long").alias("rank")))
