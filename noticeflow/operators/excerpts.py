"""Find quoted excerpts in texts.

A quote against its own document is a join on the document and a substring test
(``verification``). This module answers the wider question in which texts a quote occurs at
all. Each text is scanned once; a window of 40 characters leaves the scan only when a Bloom filter
of the wanted excerpts holds it. The filter is sized by the number of excerpts, up to a fixed size;
more excerpts are looked for in several scans. What passes is counted per 128-bit fingerprint and
joined with the fingerprints of the excerpts, which removes the chance hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.text import normalise_ws
from ..spec import QUOTE_CHARS

#: Bits of the filter for each excerpt, and those that an excerpt sets: a chance hit in about 3 * 10**6 windows or fewer.
BITS_EACH, PROBES = 48, 8
#: Least and greatest size of the filter as a power of two; the greatest (64 MiB) holds 11 million excerpts.
LEAST_BITS, MOST_BITS = 16, 29
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def excerpt(quote: Column | str) -> Column:
    """The part of a quote that must occur in the source."""
    return F.substring(normalise_ws(quote), 1, QUOTE_CHARS)


def window_hashes(text: str, width: int = QUOTE_CHARS) -> np.ndarray:
    """Hash of every window of ``width`` characters, by a rolling hash."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(points)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    powers = np.full(n, _BASE, dtype=np.uint64)
    powers[0] = 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(points * np.cumprod(powers), out=sums[1:])
    shifts = np.full(n - width + 1, _INVERSE, dtype=np.uint64)
    shifts[0] = 1
    return _mixed((sums[width:] - sums[:-width]) * np.cumprod(shifts))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ (hashes >> np.uint64(32))


def _probe(hashes: np.ndarray, step: np.ndarray, i: int, bits: int) -> np.ndarray:
    return ((hashes + np.uint64(i) * step) >> np.uint64(64 - bits)).astype(np.int64)


def _step(hashes: np.ndarray) -> np.ndarray:
    return _mixed(hashes * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)


@dataclass
class Filter:
    """Bits that the wanted excerpts set."""

    bits: int
    map: np.ndarray

    def passed(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the windows that may be wanted. Each probe looks only at what passed the ones before it."""
        at = np.arange(len(hashes))
        step = _step(hashes)
        for i in range(PROBES):
            bit = _probe(hashes[at], step[at], i, self.bits)
            at = at[(self.map[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        return at


def filter_bits(excerpts: int) -> int:
    """Size of the filter for so many excerpts, as a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * excerpts - 1).bit_length()))


def build_filter(wanted: DataFrame, bits: int) -> Filter:
    """Filter of the excerpts: put together per block of bits, so at most ``2**bits`` bits reach the driver."""

    @F.arrow_udf(ArrayType(LongType()))
    def probes(texts: pa.Array) -> pa.Array:
        hashes = np.array([window_hashes(t.as_py())[0] for t in texts], dtype=np.uint64)
        step = _step(hashes)
        places = np.stack([_probe(hashes, step, i, bits) for i in range(PROBES)], axis=1)
        return pa.array(list(places + 1), pa.list_(pa.int64()))

    bit = wanted.select(F.explode(probes("excerpt")).alias("bit"))
    parts = (
        bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
        .collect()
    )
    bitmap = np.zeros(max(2**bits // 8, 4096), dtype=np.uint8)
    for part in parts:
        block = np.frombuffer(part["map"], dtype=np.uint8)
        at = (part["bucket"] - 1) * len(block)
        bitmap[at : at + len(block)] = block
    return Filter(bits, bitmap)


def _fingerprint(text: str) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


@F.arrow_udf(StructType([StructField("f1", LongType()), StructField("f2", LongType())]))
def fingerprint(texts: pa.Array) -> pa.Array:
    """128 bits that stand for a text."""
    f1, f2 = zip(*[_fingerprint(t.as_py()) for t in texts], strict=True) if len(texts) else ((), ())
    return pa.StructArray.from_arrays([pa.array(f1, pa.int64()), pa.array(f2, pa.int64())], ["f1", "f2"])


def windows_in(texts: DataFrame, text_id: str, text: str, shared) -> DataFrame:
    """(text_id, f1, f2) of the distinct windows of each text that pass the filter."""
    id_type = texts.schema[text_id].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_ids, found = [], []
            for row, value in enumerate(batch.column(1)):
                value = value.as_py()
                windows = {_fingerprint(value[i : i + QUOTE_CHARS]) for i in shared.value.passed(window_hashes(value))}
                found.extend(windows)
                found_ids.extend([row] * len(windows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(found_ids, pa.int64())),
                    *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)),
                ],
                [text_id, "f1", "f2"],
            )

    normalised = texts.select(text_id, normalise_ws(text).alias("_text"))
    return normalised.mapInArrow(scan, f"{text_id} {id_type.simpleString()}, f1 long, f2 long")


def excerpt_hits(wanted: DataFrame, texts: DataFrame, text_id: str, text: str, most_bits: int = MOST_BITS) -> DataFrame:
    """(excerpt, texts, first_text) for the excerpts of ``wanted`` (distinct) that occur in some text.

    Excerpts beyond what a filter of ``2**most_bits`` bits holds are dealt out to several scans of the texts.
    """
    named = wanted.select("excerpt", fingerprint("excerpt").alias("_f")).select("excerpt", "_f.*")
    many = named.count()
    scans = max(1, -(-many * BITS_EACH // 2**most_bits))
    bits = min(most_bits, filter_bits(-(-many // scans)))
    found = []
    for i in range(scans):
        part = named.where(F.pmod("f1", F.lit(scans)) == i) if scans > 1 else named
        shared = texts.sparkSession.sparkContext.broadcast(build_filter(part, bits))
        # counted per fingerprint before the shuffle: a passage that many texts copy stays one row
        counted = windows_in(texts, text_id, text, shared).groupBy("f1", "f2").agg(
            F.count(F.lit(1)).alias("texts"), F.min(text_id).alias("first_text")
        )
        found.append(part.join(counted, ["f1", "f2"]).select("excerpt", "texts", "first_text"))
    return reduce(DataFrame.union, found)


def ground_excerpt(quotes: DataFrame, quote: str, texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """Add to each quote: its excerpt, ``too_short``, ``found`` and the number of ``texts``."""
    cut = quotes.withColumn("excerpt", excerpt(quote))
    wanted = cut.where(F.length("excerpt") == QUOTE_CHARS).select("excerpt").distinct()
    hits = excerpt_hits(wanted, texts, text_id, text)
    found = cut.join(hits, "excerpt", "left")
    return found.withColumns(
        {
            "too_short": F.length("excerpt") < QUOTE_CHARS,
            "found": F.col("texts").isNotNull(),
            "texts": F.coalesce("texts", F.lit(0).cast("long")),
        }
    )
