"""Documents in chunks of bounded size, and many small values packed into few rows.

An operator that must exchange a value per word over the cluster would spend most of its time on
row overhead. Here a task works on a chunk of documents, sends sorted hashes as one binary per
bucket of the hash space, and gets its answers back in the same order. Chunks are known by their
content, so a task that is run again after a lost executor asks and answers under the same key.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from noticeflow.llm import words

CHUNK_BYTES = 4 << 20
_COLUMN = struct.Struct("<IB")


def terminated(text: Column) -> Column:
    """The text with a newline behind it, so that words of neighbouring documents stay apart."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit("\n"))


def chunked(documents: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (chunk, ids, texts): neighbouring documents of about ``chunk_bytes`` each; texts end in a newline.

    A longer document is a chunk of its own. ``chunk`` is a hash of the contents.
    """
    rows = _rows(documents, id_col, text_col)
    schema = StructType(
        [
            StructField("chunk", LongType()),
            StructField("ids", ArrayType(rows.schema["ids"].dataType)),
            StructField("texts", ArrayType(StringType())),
        ]
    )
    return rows.mapInArrow(_cut(chunk_bytes), schema)


def packed_chunks(documents: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The same chunks to be shuffled: (chunk, ids, sizes, data), the texts as one zstandard frame."""
    rows = _rows(documents, id_col, text_col)
    schema = StructType(
        [
            StructField("chunk", LongType()),
            StructField("ids", ArrayType(rows.schema["ids"].dataType)),
            StructField("sizes", ArrayType(LongType())),
            StructField("data", BinaryType()),
        ]
    )

    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in _cut(chunk_bytes)(batches):
            data, offsets = text_bytes(batch.column("texts").values)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("chunk"),
                    batch.column("ids"),
                    _one_list(pa.array(np.diff(offsets), pa.int64())),
                    pa.array([packer.compress(data)], pa.binary()),
                ],
                schema.names,
            )

    return rows.mapInArrow(pack_texts, schema)


def chunk_texts(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a chunk's texts, packed or not."""
    if "data" not in batch.schema.names:
        return text_bytes(batch.column("texts")[i].values)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("data")[i].as_buffer()), dtype=np.uint8)
    return data, np.concatenate([[0], np.cumsum(batch.column("sizes")[i].values.to_numpy())])


def map_chunks(documents: DataFrame, id_col: str, text_col: str, function, schema, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``chunked(...).mapInArrow(function, schema)`` in one Python worker, so that chunks don't go back and forth."""
    cut = _cut(chunk_bytes)
    return _rows(documents, id_col, text_col).mapInArrow(lambda batches: function(cut(batches)), schema)


def _rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).alias("ids"), terminated(F.col(text_col)).alias("texts"))


def _cut(chunk_bytes: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = text_offsets(batch.column("texts"))
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(offsets, offsets[at] + chunk_bytes, side="right")) - 1
                part = batch.slice(at, max(1, to - at))
                at += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk_key(part)], pa.int64()), _one_list(part.column("ids")), _one_list(part.column("texts"))],
                    ["chunk", "ids", "texts"],
                )

    return cut


def text_offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the offsets of each text in them, without a copy."""
    offsets = text_offsets(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunk_key(part: pa.RecordBatch) -> int:
    data, offsets = text_bytes(part.column("texts"))
    digest = xxhash.xxh3_64(data)
    digest.update(np.ascontiguousarray(offsets))
    digest.update(repr(part.column("ids").to_pylist()).encode())
    return int(np.uint64(digest.intdigest()).astype(np.int64))


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Single rows of the batches, so that memory is bounded by one chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch, i


def chunk_words(texts: pa.Array):
    """(bytes, text offsets, word starts, word ends, index of the document of each word)"""
    data, offsets = text_bytes(texts)
    starts, ends = words.spans(data)
    return data, offsets, starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def bucket_bounds(buckets: int) -> np.ndarray:
    """Lower bounds of equal ranges of the 64-bit space, without the first (0)."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)


def bucket_cuts(ordered: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the buckets of sorted hashes begin and end."""
    return np.concatenate([[0], np.searchsorted(ordered, bounds), [len(ordered)]])


def pack_sorted(ordered: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte planes apart: the high planes are nearly all zero."""
    steps = np.diff(ordered, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + planes[:used].tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    used = packed[0]
    planes = np.frombuffer(packed, dtype=np.uint8, offset=1).reshape(used, -1)
    steps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    steps[:, :used] = planes.T
    return np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Numbers of eight bytes, byte planes apart, so that what they have in common compresses away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(packed: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def pack_numbers(*columns: np.ndarray) -> bytes:
    """Columns of numbers from zero up as one zstandard frame: of each the byte planes that are in use."""
    head, body = [bytes([len(columns)])], []
    for values in columns:
        used = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
        head.append(_COLUMN.pack(len(values), used))
        body.append(np.ascontiguousarray(values, dtype="<i8").view(np.uint8).reshape(-1, 8)[:, :used].T.tobytes())
    return zstandard.compress(b"".join(head + body), 1)


def unpack_numbers(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(packed)
    at, out = 1 + raw[0] * _COLUMN.size, []
    for size, used in _COLUMN.iter_unpack(raw[1:at]):
        planes = np.zeros((size, 8), dtype=np.uint8)
        planes[:, :used] = np.frombuffer(raw, dtype=np.uint8, count=size * used, offset=at).reshape(used, size).T
        out.append(planes.reshape(-1).view("<i8"))
        at += size * used
    return out


def steps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ascending runs of the given sizes (none of them empty) as differences; the first of a run stays."""
    out = np.diff(values, prepend=0)
    first = np.cumsum(sizes) - sizes
    out[first] = values[first]
    return out


def unsteps(differences: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.cumsum(differences)
    first = np.cumsum(sizes) - sizes
    return sums - np.repeat(sums[first] - differences[first], sizes)


def bucket_count(documents: DataFrame, text_col: str, bucket_bytes: int) -> int:
    """Number of hash buckets for which one holds the hashes of about ``bucket_bytes`` of text."""
    total = documents.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes), 1)
