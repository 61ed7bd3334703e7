"""Vectorised words and hashes over the UTF-8 bytes of an Arrow column.

Words are runs of bytes outside space and 0x09-0x0D. Hashes are 64 bits: a polynomial of mixed byte values,
read off a running sum, then mixed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15  # odd
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values (the splitmix64 finaliser)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(256, dtype=np.uint64), 7)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and doubled."""
    had = _powers.get(base)
    if had is None or len(had) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        new = np.full(size, base, np.uint64)
        new[0] = 1
        had = _powers[base] = np.multiply.accumulate(new)
    return had[:n]


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial hash of values[start:end] for each pair, mixed."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(values) + 1)[starts], 3) + (ends - starts).astype(np.uint64)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each row and the bytes of all rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]] if col.buffers()[2] else np.zeros(0, np.uint8)
    return offs - offs[0], data


def pieces(offs: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word's number of each row (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~SPACE[data]
    begin, end = solid.copy(), solid.copy()
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    begin[1:] &= ~solid[:-1] | cut[1:-1]
    end[:-1] &= ~solid[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive word hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(hashes) - n + 1)
    return rolled(hashes, at, at + n)


def shingle_sets(offs: np.ndarray, data: np.ndarray, n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """For each row its set of distinct n-word shingles as sorted hashes; fewer words make one shingle."""
    for i, j in pieces(offs):
        part = data[offs[i] : offs[j]]
        starts, ends, first = words(offs[i : j + 1] - offs[i], part)
        values = BYTES[LOWER[part]] if lower else BYTES[part]
        w = rolled(values, starts, ends)
        every = grams(w, n)
        for k in range(j - i):
            a, b = first[k], first[k + 1]
            if b - a >= n:
                yield np.unique(every[a : b - n + 1])
            elif b > a:
                yield rolled(w[a:b], np.array([0]), np.array([b - a]))
            else:
                yield np.zeros(0, np.uint64)
