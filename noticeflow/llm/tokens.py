"""Token ids of documents in compressed files: one zstandard frame per document, a shared dictionary, and an index."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from noticeflow.llm import tables, words

#: Distinct pieces of text whose ids a worker remembers, and their bytes; beyond, it keeps what it has met again. About 10 MB.
KNOWN_PIECES, KNOWN_BYTES = 250_000, 16 << 20
#: Text encoded at once, texts or frames that Spark hands to Python at once, and compressed frames in a row of the files.
ENCODE_BYTES, BATCH_BYTES = 2 << 20, 4 << 20
#: New pieces that are encoded as one text, and texts handed to the library at once.
JOINED, AT_ONCE = 64, 64
BLOCK_BYTES = 4 << 20

# White space beyond ASCII, or taken as such by some engines: texts with it are encoded in one piece.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_ASCII_ODD_SPACE = re.compile("[\x1c-\x1f]")


class Encoder:
    """Ids of texts, equal to those of the tokenizer for the whole text.

    A byte-level tokenizer never merges over a change from other characters to white space, so each run of white space
    with the word behind it has ids of its own, and a repeated one is looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # the library looks for added tokens before it splits a text: texts that hold one are encoded in one piece
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        # side by side, pieces could only form an added token that holds white space
        self.joins = not any(re.search(r"\s", content) for content in self.added)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        vocabulary = self.tokenizer.get_vocab()
        # a character of a byte-level token stands for a byte
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.sizes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.ids = np.empty(0, dtype=self.width)
        self.offsets = np.zeros(1, dtype=np.int64)
        self.again = np.empty(0, dtype=bool)

    def bound(self) -> None:
        """If too much is remembered, keep the pieces that were met again, or none if these are more than half of it."""
        if len(self.known) <= KNOWN_PIECES and self.known.nbytes <= KNOWN_BYTES:
            return
        kept = np.flatnonzero(self.again)
        known = self.known.filter(pa.array(self.again))
        if 2 * len(known) > KNOWN_PIECES or 2 * known.nbytes > KNOWN_BYTES:
            return self.forget()
        lengths = np.diff(self.offsets)[kept]
        self.ids = self.ids[_spans(self.offsets[kept], lengths)]
        self.known, self.offsets = known, np.concatenate([[0], np.cumsum(lengths)])
        self.again = np.zeros(len(kept), dtype=bool)

    def _in_one_piece(self, text: str) -> bool:
        odd = _ASCII_ODD_SPACE if text.isascii() else _ODD_SPACE
        return any(content in text for content in self.added) or odd.search(text) is not None

    def _numbers(self, pieces: pa.LargeBinaryArray) -> np.ndarray:
        """Places of distinct pieces among the known ones, to which the new ones are added."""
        numbers = pc.index_in(pieces, self.known).fill_null(-1).to_numpy().astype(np.int64)
        met, new = numbers[numbers >= 0], np.flatnonzero(numbers < 0)
        self.again[met] = True
        if len(new):
            numbers[new] = len(self.known) + self._learn(pieces.take(pa.array(new)))
        return numbers

    def _learn(self, new: pa.LargeBinaryArray) -> np.ndarray:
        """Put pieces and their ids behind those that are known; gives their order there."""
        # Pieces between white space and a word's end keep their ids side by side, so many are encoded as one text.
        tops, data = _buffers(new)
        inside = self.joins & words.SPACE[data[tops[:-1]]] & ~words.SPACE[data[tops[1:] - 1]]
        inner, outer = new.filter(pa.array(inside)), new.filter(pa.array(~inside))
        ids, lengths = [self.ids], []
        tops, data = _buffers(inner)
        for at in range(0, len(inner), JOINED * AT_ONCE):
            to = min(at + JOINED * AT_ONCE, len(inner))
            bounds = tops[[*range(at, to, JOINED), to]].tolist()
            ids.append(self._encoded([str(data[a:b], "utf-8") for a, b in zip(bounds, bounds[1:])])[0])
            ends = np.searchsorted(np.cumsum(self.sizes[ids[-1]]), tops[at + 1 : to + 1] - tops[at]) + 1
            lengths.append(np.diff(ends, prepend=0))
        for at in range(0, len(outer), JOINED * AT_ONCE):
            texts = [piece.decode() for piece in outer.slice(at, JOINED * AT_ONCE).to_pylist()]
            for found, values in zip((ids, lengths), self._encoded(texts), strict=True):
                found.append(values)
        self.ids = np.concatenate(ids)
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate(lengths))])
        self.again = np.concatenate([self.again, np.zeros(len(new), dtype=bool)])
        self.known = pa.concat_arrays([self.known, inner, outer])
        return np.where(inside, np.cumsum(inside) - 1, len(inner) + np.cumsum(~inside) - 1)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one behind the other, and their numbers."""
        found = [np.array(x.ids, dtype=self.width) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found), np.array([len(x) for x in found], dtype=np.int64)

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        self.bound()
        parts, whole = [], {}
        for i, text in enumerate(texts):
            if self._in_one_piece(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                whole[i] = np.array([*ids, end], dtype=self.width)
                parts.append(b"")
            else:
                parts.append(text.encode())
        pieces, counts = _pieces(parts)
        found = pieces.dictionary_encode()
        at = self._numbers(found.dictionary)[found.indices.to_numpy()]
        first, lengths = self.offsets[at], self.offsets[at + 1] - self.offsets[at]
        flat = self.ids[_spans(first, lengths)]
        tops = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        stop = np.array([end], dtype=self.width)
        return [
            whole[i] if i in whole else np.concatenate([flat[tops[i] : tops[i + 1]], stop]) for i in range(len(texts))
        ]


def _pieces(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The pieces of all texts, one behind the other, and how many each has. A piece is white space with the word behind it."""
    tops = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    space = words.SPACE[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[1:-1] = space[1:] & ~space[:-1]
    begins[tops] = True
    offsets = np.flatnonzero(begins)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)
    return pieces, np.diff(np.searchsorted(offsets, tops))


def _buffers(pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of pieces, and the bytes in which they lie."""
    _, bounds, data = pieces.buffers()
    offsets = np.frombuffer(bounds, dtype=np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    return offsets, np.frombuffer(data or b"", dtype=np.uint8)


def _spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places ``first``, ``first + 1``, ... of all spans, one behind the other."""
    ends = np.cumsum(lengths)
    places = np.repeat(first - (ends - lengths), lengths)
    places += np.arange(len(places))
    return places


encoder = cache(Encoder)


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """(some rows of a batch, ids of their texts). What is remembered within the bound serves later tasks of the worker."""
    own = encoder(tokenizer)
    for batch in batches:
        texts = batch.column("text")
        sizes = np.cumsum(np.array([len(t.as_buffer()) for t in texts], dtype=np.int64))
        at = 0
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + ENCODE_BYTES, side="right")))
            yield batch.slice(at, to - at), own.encode(texts.slice(at, to - at).to_pylist(), end)
            at = to
    own.bound()


def write_tokens(
    documents: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end: int = 0,
    sample_docs: int = 2000,
    dictionary_bytes: int = 64 << 10,
    level: int = 3,
) -> str:
    """Encode all texts and write them in ascending order of id; ``tokenizer`` is a file of the tokenizers library.

    The folder ``path`` gets three tables. ``dictionary``: the zstandard dictionary, its hash, the width of an id.
    ``blocks``: per row some documents of a shard: ids, token counts, offsets of their frames, first token of each in the
    shard, the frames, and the hash of the dictionary they need. ``shards``: first token of each shard among all.

    The dictionary is trained on the serialized ids of about ``sample_docs`` documents (at most twice as many, 16 kB of
    each), chosen by a hash of their text; everything else covers all rows. Null texts are empty ones: a document of the
    end id alone. Rows with equal ids are separate documents, in an order given by their texts; null ids come first.
    An empty table gives files without documents. Further columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dictionary, width = _train(docs, tokenizer, end, sample_docs, dictionary_bytes)
    key = xxhash.xxh64_hexdigest(dictionary)
    spark.createDataFrame([(key, dictionary, width)], "dictionary string, content binary, width string").write.parquet(
        f"{path}/dictionary"
    )
    frame = StructType(
        [
            StructField("id", docs.schema["id"].dataType),
            StructField("tie", LongType()),
            StructField("n_tokens", LongType()),
            StructField("frame", BinaryType()),
        ]
    )

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _compressor(dictionary, level)
        for batch, found in encoded(batches, tokenizer, end):
            counts = [len(ids) for ids in found]
            frames = [packer.compress(ids.tobytes()) for ids in found]
            arrays = [batch.column("id"), batch.column("tie"), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, frame.names)

    with _small_batches(spark):
        frames = tables.staged(docs.withColumn("tie", F.xxhash64("text")).mapInArrow(words.freeing(compress), frame), "frames")
    ordered = frames.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "n_tokens", "frame")
    block = StructType(
        [
            StructField("shard", IntegerType()),
            StructField("dictionary", StringType()),
            StructField("n_block", LongType()),
            StructField("ids", ArrayType(frame["id"].dataType)),
            StructField("n_tokens", ArrayType(LongType())),
            StructField("first_token", ArrayType(LongType())),
            StructField("offsets", ArrayType(LongType())),
            StructField("frames", BinaryType()),
        ]
    )
    with _small_batches(spark):
        ordered.select("id", "n_tokens", "frame").mapInArrow(words.freeing(_blocks(key, block)), block).write.parquet(f"{path}/blocks")
    totals = spark.read.schema(block).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_block").alias("n"))
    first, rows = 0, []
    for shard, n in sorted(totals.collect()):  # a row per file, not per document
        rows.append((shard, first))
        first += n
    spark.createDataFrame(rows, "shard int, shard_first long").coalesce(1).write.parquet(f"{path}/shards")
    return path


def _train(docs: DataFrame, tokenizer: str, end: int, sample_docs: int, size: int) -> tuple[bytes, str]:
    n = docs.count()
    share = min(1.0, sample_docs / max(n, 1))
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(share * (1 << 40)))
    # the sample is of texts' heads, spread over all tasks
    chosen = chosen.select(F.substring("text", 1, 64 << 10).alias("text")).limit(2 * sample_docs)
    chosen = chosen.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("text"))

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in encoded(batches, tokenizer, end):
            ids = [ids.tobytes()[: 16 << 10] for ids in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["sample"])

    with _small_batches(docs.sparkSession):
        samples = sorted(bytes(r.sample) for r in chosen.mapInArrow(words.freeing(serialize), "sample binary").collect())
    width = encoder(tokenizer).width
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes(), width
    except zstandard.ZstdError:  # too little to train on: the samples themselves
        return b"".join(samples)[:size], width


def _small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Inside, a task and its worker hold a few MB of texts or frames at a time, instead of 64 each."""
    return tables.setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=_dictionary(content))


def _blocks(key: str, schema: StructType):
    """Frames in order, put together to rows of the files."""

    def put(shard: int, held: list, first: int) -> pa.RecordBatch:
        counts = np.array([x[1] for x in held], dtype=np.int64)
        sizes = np.array([len(x[2]) for x in held], dtype=np.int64)
        lists = [
            pa.array(counts),
            pa.array(first + np.cumsum(counts) - counts),
            pa.array(np.cumsum(sizes) - sizes),
        ]
        ids = pa.concat_arrays([x[0] for x in held])
        one = pa.array([0, len(held)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()),
                pa.array([key]),
                pa.array([int(counts.sum())], pa.int64()),
                pa.ListArray.from_arrays(one, ids),
                *(pa.ListArray.from_arrays(one, x) for x in lists),
                pa.array([b"".join(x[2] for x in held)], pa.binary()),
            ],
            schema.names,
        )

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        held, size, first = [], 0, 0
        for batch in batches:
            ids, counts, frames = (batch.column(c) for c in ("id", "n_tokens", "frame"))
            for i in range(batch.num_rows):
                held.append((ids.slice(i, 1), counts[i].as_py(), frames[i].as_py()))
                size += len(held[-1][2])
                if size >= BLOCK_BYTES:
                    yield put(shard, held, first)
                    first += sum(x[1] for x in held)
                    held, size = [], 0
        if held:
            yield put(shard, held, first)

    return group


def read_tokens(spark: SparkSession, path: str, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """``id, start, n_tokens, ids`` of every document of the files.

    ``start`` counts the tokens of all documents before it; ``ids`` are little-endian unsigned 32-bit integers (see
    :func:`as_array`). ``only``: a condition on an id; frames of other documents are not decompressed.
    """
    shards = spark.read.parquet(f"{path}/shards")
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(shards), "shard")  # a row per file
    rows = blocks.select(
        "dictionary",
        "frames",
        F.filter(
            F.transform(
                F.sequence(F.lit(0), F.size("ids") - 1),
                lambda i: F.struct(
                    F.get("ids", i).alias("id"),
                    (F.col("shard_first") + F.get("first_token", i)).alias("start"),
                    F.get("offsets", i).alias("at"),
                    F.coalesce(F.get("offsets", i + 1), F.octet_length("frames").cast("long")).alias("to"),
                ),
            ),
            lambda x: F.lit(True) if only is None else only(x["id"]),
        ).alias("wanted"),
    ).where(F.size("wanted") > 0)
    stored = spark.read.parquet(f"{path}/dictionary").first()
    content, key, width = bytes(stored.content), stored.dictionary, stored.width
    id_type = blocks.schema["ids"].dataType.elementType
    schema = StructType(
        [
            StructField("id", id_type),
            StructField("start", LongType()),
            StructField("n_tokens", LongType()),
            StructField("ids", BinaryType()),
        ]
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("dictionary")[i].as_py() != key:
                    raise ValueError("the frames need another dictionary")
                frames = batch.column("frames")[i].as_buffer()
                wanted = batch.column("wanted")[i].values
                spans = list(zip(wanted.field("at").to_pylist(), wanted.field("to").to_pylist(), strict=True))
                for at in range(0, len(spans), 1000):
                    part = [np.frombuffer(unpacker.decompress(frames[a:b]), dtype=width) for a, b in spans[at : at + 1000]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            wanted.field("id").slice(at, len(part)),
                            wanted.field("start").slice(at, len(part)),
                            pa.array([len(x) for x in part], pa.int64()),
                            pa.array([x.astype("<u4").tobytes() for x in part], pa.binary()),
                        ],
                        schema.names,
                    )

    return rows.mapInArrow(words.freeing(decode), schema)


def as_array(ids: Column) -> Column:
    """Stored ids as an array of numbers."""

    @F.arrow_udf("array<bigint>")
    def unpack(packed: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x.as_buffer(), dtype="<u4").astype(np.int64) for x in packed], pa.list_(pa.int64()))

    return unpack(ids)
