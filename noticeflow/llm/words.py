"""Words and word hashes of texts: as Spark columns, and vectorised over UTF-8 bytes inside tasks."""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions.text import let

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
# Everything in ASCII that is neither a digit nor a lower-case letter parts words.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Byte tables: white space of the form [\x20\x09-\x0D], and lower-casing of A-Z only.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())

_LIBC = ctypes.CDLL(None)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def word_array(text: Column | str) -> Column:
    """Alphanumeric words of a text with A-Z lower-cased; null gives an empty array."""
    column = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(lower_ascii(F.coalesce(column, F.lit(""))), WORD_GAP), "")


def lower_ascii(column: Column) -> Column:
    """Lower-case A-Z only. On texts of ASCII alone ``lower`` does just that, and is many times faster."""
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def over_runs(values: Column, size: int, combine: Callable[[Column, Column], Column]) -> Column:
    """``combine`` over every run of ``size`` values, by doubling: a few passes over the array, whatever the size.

    Runs overlap while they double, so ``combine`` must give equal results for equal runs, as a hash or a minimum does.
    The array must hold at least ``size`` values.
    """
    if size == 1:
        return values
    half = 1 << ((size - 1).bit_length() - 1)
    return let(over_runs(values, half, combine), lambda h: F.zip_with(
        F.slice(h, 1, F.size(h) - (size - half)), F.slice(h, size - half + 1, F.size(h)), combine
    ))


def gram_hashes(w: Column, gram: int) -> Column:
    """Hash of every run of ``gram`` words; there must be so many."""
    return over_runs(F.transform(w, lambda x: F.xxhash64(x)), gram, lambda a, b: F.xxhash64(a, b))


def text_keys(text: Column | str) -> list[Column]:
    """128 bits that stand for a text in joins; null is a text of its own."""
    column = F.col(text) if isinstance(text, str) else text
    return [F.xxhash64(column).alias("_t1"), F.xxhash64(F.lit("text"), column, F.length(column)).alias("_t2")]


def mix(values: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values, so that every output bit depends on every input bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """multiplier**i and its inverse, modulo 2**64, for i below n or more."""
    known = _powers.get(multiplier)
    if known is None or len(known[0]) < n:
        size = max(n, _BLOCK + 1)
        inverse = pow(multiplier, -1, 1 << 64)
        pair = []
        for base in (multiplier, inverse):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        known = _powers[multiplier] = (pair[0], pair[1])
    return known


def freeing(function: Callable) -> Callable:
    """A function over batches that gives what its task has freed back to the system, as workers live on."""

    def run(batches):
        yield from function(batches)
        release()

    return run


def release() -> None:
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def spans(data: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not in the gap table."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~gap[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the words at the given byte spans, in blocks of bounded size."""
    out = np.empty(len(starts), dtype=np.uint64)
    base = int(_MULTIPLIER)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, side="right")))
        low, high = int(starts[at]), int(ends[to - 1])
        up, down = powers(base, high - low + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        first, last = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[last] - sums[first]) * down[first]
        out[at:to] = mix(out[at:to] + (last - first).astype(np.uint64) * _MULTIPLIER)
        at = to
    return out


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``size`` consecutive word hashes."""
    n = len(hashes)
    if n < size:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(0xD6E8FEB86659FD93, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1])
