"""Keys that fingerprints within a few bits of each other share, from the binary Golay code of 23 bits."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, DATA_BITS = 23, 12
CHECK_BITS = LENGTH - DATA_BITS
# Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the perfect code that corrects three errors.
GENERATOR = 0b110001110101

#: Segments of a 64-bit fingerprint; the last one is padded with zero bits.
SEGMENTS = (23, 23, 18)
TOLERANCE = 4


def syndromes(vectors: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit vectors modulo the generator: zero for codewords."""
    rest = vectors.astype(np.int64)
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ GENERATOR << bit - CHECK_BITS, rest)
    return rest


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of up to three bits, and the differences of all codewords within four bits.

    Up to two errors leave one codeword so near. Three lie in five words of weight seven of the code, which lead to five
    further codewords at four bits. Unused places hold -1.
    """
    patterns = [sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(LENGTH), n)]
    leader = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    leader[syndromes(np.array(patterns))] = patterns
    words = np.arange(1 << DATA_BITS, dtype=np.int64) << CHECK_BITS
    words ^= syndromes(words)
    sevens = words[np.bitwise_count(words) == 7]
    near = np.full((1 << CHECK_BITS, 6), -1, dtype=np.int64)
    near[:, 0] = leader
    for syndrome, error in enumerate(leader):
        if error.bit_count() == 3:
            near[syndrome, 1:] = error ^ sevens[(sevens & error) == error]
    return leader, near


def near_codewords(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all codewords within four bits of each segment, six places each, and which places are used.

    Segments that differ in at most two bits share one of them: the codeword nearest to a vector between the two is
    within three bits of it, and within four of both.
    """
    _, near = _tables()
    offsets = near[syndromes(segments)]
    return (segments[:, None] ^ offsets) >> CHECK_BITS, offsets >= 0


def split(fingerprints: np.ndarray) -> list[np.ndarray]:
    """The three segments of unsigned 64-bit fingerprints."""
    parts, at = [], 0
    for size in SEGMENTS:
        parts.append((fingerprints >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(np.int64))
        at += size
    return parts


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key): fingerprints that differ in up to four bits share a key.

    Either no segment holds more than two of the errors: then all three segments share a near codeword, and their three
    indices are the key (36 bits). Or one holds three or four, and at most one is left: then of the other two segments
    one is equal and the other shares a near codeword (30 or 35 bits). Keys this wide keep chance meetings few.
    """
    parts = split(fingerprints)
    codes, used = zip(*(near_codewords(p) for p in parts), strict=True)
    together = codes[0][:, :, None, None] << 24 | codes[1][:, None, :, None] << 12 | codes[2][:, None, None, :]
    valid = used[0][:, :, None, None] & used[1][:, None, :, None] & used[2][:, None, None, :]
    row, *_ = np.nonzero(valid)
    rows, out = [row], [together[valid]]
    for kind, (equal, close) in enumerate([(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)], start=1):
        pair = parts[equal][:, None] << DATA_BITS | codes[close] | kind << 40
        row, _ = np.nonzero(used[close])
        rows.append(row)
        out.append(pair[used[close]])
    return np.concatenate(rows), np.concatenate(out)
