"""Removal of passages that occur more than once, by counting the hash of every window of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from noticeflow.llm import chunks, words

#: Text whose window hashes one counting task holds, about 10 MB of hashes.
BUCKET_BYTES = 8 << 20


def remove_repeats(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Remove each word that a repeated window of ``window`` words covers.

    Words are runs of characters other than ASCII white space. A window is repeated if its words also start anywhere
    else, in the same document or another; all windows are judged on the input. Returns a row per input row:
    ``id_col, n_words, n_removed, kept`` (kept words joined by one space) and ``removed`` (maximal intervals of removed
    words, first and one past the last). Other columns are ignored.

    Null texts and empty ones have no words; documents shorter than the window lose nothing; repeated rows count as
    separate documents, so their windows repeat; null ids are kept. An empty table gives an empty result.

    The Rabin-Karp hashes of every window (64 bits) are sent once per chunk of documents to the counting task of their
    range, so that a passage in every document costs a row per chunk, not per document. The answer is a bit per hash.
    A chance collision needs about 2**32 windows to be likely; it would remove one window too many.
    """
    buckets = chunks.bucket_count(documents, text_col, bucket_bytes)
    rows = chunks.chunked(documents, id_col, text_col)
    asked = rows.select("chunk", "texts").mapInArrow(
        _ask(window, buckets), "chunk long, bucket int, hashes binary, twice binary"
    )
    answered = asked.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, repeated binary")
    answers = answered.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "repeated")).alias("answers"))
    joined = rows.join(answers, "chunk", "left").select("ids", "texts", "answers")
    id_type = rows.schema["ids"].dataType.elementType
    interval = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType(
        [
            StructField(id_col, id_type),
            StructField("n_words", LongType()),
            StructField("n_removed", LongType()),
            StructField("kept", StringType()),
            StructField("removed", ArrayType(interval)),
        ]
    )
    return joined.mapInArrow(_remove(window, buckets, schema.names), schema)


def _windows(texts: pa.Array, window: int):
    """Words of a chunk, the start words of its windows (none crosses documents) and their hashes."""
    data, offsets, starts, ends, doc = chunks.chunk_words(texts)
    hashes = words.rolling(words.word_hashes(data, starts, ends), window)
    whole = doc[: len(hashes)] == doc[window - 1 :] if len(hashes) else np.empty(0, dtype=bool)
    at = np.flatnonzero(whole)
    return data, offsets, starts, ends, doc, at, hashes[at]


def _ask(window: int, buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = chunks.bucket_bounds(buckets)
        for batch, i in chunks.chunk_rows(batches):
            *_, hashes = _windows(batch.column("texts")[i].values, window)
            distinct, counts = np.unique(hashes, return_counts=True)
            cuts = chunks.bucket_cuts(distinct, bounds)
            used = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("chunk")[i].as_py()] * len(used), pa.int64()),
                    pa.array(used, pa.int32()),
                    pa.array([chunks.pack_sorted(distinct[cuts[b] : cuts[b + 1]]) for b in used], pa.binary()),
                    pa.array([np.packbits(counts[cuts[b] : cuts[b + 1]] > 1).tobytes() for b in used], pa.binary()),
                ],
                ["chunk", "bucket", "hashes", "twice"],
            )

    return ask


def _answer(group: pa.Table) -> pa.Table:
    hashes = [chunks.unpack_sorted(x.as_py()) for x in group.column("hashes")]
    sizes = [len(x) for x in hashes]
    twice = np.concatenate(
        [
            np.unpackbits(np.frombuffer(x.as_py(), dtype=np.uint8), count=n).astype(bool)
            for x, n in zip(group.column("twice"), sizes, strict=True)
        ]
    )
    together = np.concatenate(hashes)
    order = np.argsort(together, kind="stable")
    same = np.diff(together[order]) == 0
    repeated = np.zeros(len(together), dtype=bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    found = twice
    found[order] |= repeated
    parts = np.split(found, np.cumsum(sizes)[:-1])
    return pa.table(
        {
            "chunk": group.column("chunk"),
            "bucket": group.column("bucket"),
            "repeated": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary()),
        }
    )


def _remove(window: int, buckets: int, names: list[str]):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = chunks.bucket_bounds(buckets)
        for batch, i in chunks.chunk_rows(batches):
            data, offsets, starts, ends, doc, at, hashes = _windows(batch.column("texts")[i].values, window)
            distinct, inverse = np.unique(hashes, return_inverse=True)
            cuts = chunks.bucket_cuts(distinct, bounds)
            repeated = np.zeros(len(distinct), dtype=bool)
            answers = {x["bucket"]: x["repeated"] for x in batch.column("answers")[i].as_py() or []}
            for b in np.flatnonzero(np.diff(cuts)):
                # a KeyError here means that the input gave other rows than in the first pass
                bits = np.frombuffer(answers[int(b)], dtype=np.uint8)
                repeated[cuts[b] : cuts[b + 1]] = np.unpackbits(bits, count=cuts[b + 1] - cuts[b])
            hit = at[repeated[inverse]]
            edges = np.zeros(len(starts) + 1, dtype=np.int32)
            np.add.at(edges, hit, 1)
            np.add.at(edges, hit + window, -1)
            covered = np.cumsum(edges[:-1]) > 0
            yield _result(batch.column("ids")[i].values, data, offsets, starts, ends, doc, covered, names)

    return remove


def _result(ids, data, offsets, starts, ends, doc, covered, names) -> pa.RecordBatch:
    n = len(ids)
    kept = ~covered
    # A kept word takes its bytes and the separator behind it, which becomes a space.
    text = data.copy()
    text[ends[kept]] = 0x20
    edges = np.zeros(len(data) + 2, dtype=np.int8)
    edges[starts[kept]] += 1
    edges[ends[kept] + 1] -= 1
    text = text[np.cumsum(edges[: len(data)], dtype=np.int8) > 0]
    lengths = np.bincount(doc[kept], weights=ends[kept] - starts[kept] + 1, minlength=n).astype(np.int64)
    tops = np.cumsum(lengths)
    raw = text.tobytes()
    texts = [raw[top - size : max(top - size, top - 1)].decode() for top, size in zip(tops, lengths, strict=True)]
    # Intervals: a removed word whose predecessor in its document is kept begins one, and so on.
    first_word = np.searchsorted(starts, offsets[:-1])
    before = np.concatenate([[False], covered[:-1]]) & (np.concatenate([[-1], doc[:-1]]) == doc)
    behind = np.concatenate([covered[1:], [False]]) & (np.concatenate([doc[1:], [-1]]) == doc)
    begin, end = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~behind)
    each = np.searchsorted(doc[begin], np.arange(n + 1)) if len(begin) else np.zeros(n + 1, dtype=np.int64)
    intervals = pa.ListArray.from_arrays(
        pa.array(each, pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(begin - first_word[doc[begin]], pa.int64()), pa.array(end + 1 - first_word[doc[end]], pa.int64())],
            ["start", "end"],
        ),
    )
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(np.bincount(doc, minlength=n), pa.int64()),
            pa.array(np.bincount(doc[covered], minlength=n), pa.int64()),
            pa.array(texts, pa.string()),
            intervals,
        ],
        names,
    )
