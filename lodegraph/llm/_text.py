"""NumPy kernels over Arrow text columns: words, word shingles and their hashes, a slice of documents at a time.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D with A-Z lower-cased. These bytes never occur inside a
longer UTF-8 sequence, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] = _LOWER[97:123]
_BASE = 0x9E3779B97F4A7C15
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_powers = (np.ones(0, dtype=np.uint64), np.ones(0, dtype=np.uint64))


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2**64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n + n // 4 + 16, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = tuple(made)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, n + 1 offsets of the rows in them); null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, buffers = len(column), column.buffers()
    if not n:
        return
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, their first byte and the byte after their last, and the n + 1 word offsets of the rows."""
    size = len(data)
    if not size:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none, np.zeros(len(starts), dtype=np.int64)
    solid = ~_SPACE[data]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    before[starts[:-1][starts[:-1] < size]] = False
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    after[starts[1:][starts[1:] > 0] - 1] = False
    first, last = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    powers, inverse = _powers_of(size)
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(_LOWER[data] * powers, out=sums[1:])
    hashes = mixed((sums[last] - sums[first]) * inverse[first])
    return hashes, first, last, np.searchsorted(first, starts)


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts): row r has counts[r] shingles of k words, from values[rows[r]] on; fewer words make one shingle of all."""
    n, counts = len(hashes), np.diff(rows)
    values = np.zeros(n, dtype=np.uint64)
    if n >= k:
        total = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            total += hashes[j : n - k + 1 + j] * _STEPS[j % 5] * np.uint64(1 + 2 * (j // 5))
        values[: n - k + 1] = mixed(total)
    for short in range(1, k):
        at = rows[:-1][counts == short]
        if len(at):
            total = np.full(len(at), short, dtype=np.uint64) * np.uint64(_BASE)
            for j in range(short):
                total += hashes[at + j] * _STEPS[j % 5] * np.uint64(1 + 2 * (j // 5))
            values[at] = mixed(total)
    return values, np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
