"""Arrow and numpy helpers shared by the corpus operators.

Words are maximal runs of bytes other than the ASCII white space 0x20 and 0x09-0x0D, which is
exactly how ``bytes.split()`` cuts; UTF-8 continuation bytes never collide with these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = (np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n at least, kept for the worker's life."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public MurmurHash3 one)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def binary_column(column: pa.Array) -> pa.Array:
    """The column as large binary without nulls (null becomes the empty string)."""
    return column.cast(pa.large_binary()).fill_null(b"")


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text; a longer row is a range of its own."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(len(column), max(at + 1, end))
        yield at, end
        at = end


def hashed_words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, 64-bit hash of each word) in text order, over a large-binary column.

    The hash is a polynomial one modulo 2**64, taken from one running sum over the whole buffer, so no
    Python code runs per word.
    """
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _power_table(_BASE, len(data)), out=total[1:])
    h = (total[ends] - total[starts]) * _power_table(_INVERSE, len(data))[starts]
    return np.searchsorted(offsets, starts, side="right") - 1, mix(h ^ (ends - starts).astype(np.uint64))
