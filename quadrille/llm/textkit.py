"""Vectorised text primitives over Arrow string batches.

All functions work on whole texts.  A batch is cut into blocks of whole documents (about ``BLOCK`` bytes,
more when a single document is longer) so that the working arrays stay in the processor's cache; cutting
never changes a result, because no value depends on a neighbouring document.

Conventions: null and empty texts have no tokens.  A word is a maximal run of ASCII letters and digits and
of non-ASCII characters, after lower-casing.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


def release() -> None:
    """Gives freed memory back to the system: workers live on from stage to stage, and would keep the most they ever had."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def strings(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> pa.Array:
    """One large_string array without nulls (a null becomes the empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    return pc.utf8_lower(column) if lower else column


def blocks(column: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) with offsets[0] == 0 for consecutive runs of whole texts."""
    arr = strings(column, lower)
    n = len(arr)
    if not n:
        return
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + size, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end
    release()


_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for i, b in enumerate((_BASE, _INV)):
            p = np.full(size, np.uint64(b), np.uint64)
            p[0] = 1
            _POW[i] = np.cumprod(p, dtype=np.uint64)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that don't cross a text's border."""
    n = len(member)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = member[:-1]
    starts = np.flatnonzero(member & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = member[1:]
    return starts, np.flatnonzero(member & (~after | cut[1:])) + 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, the same wherever the span lies."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words; and the first word of each text (with a closing total)."""
    starts, ends = runs(WORD[data], offs)
    return starts, ends, span_hash(data, starts, ends), np.searchsorted(starts, offs)


def white_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of characters that aren't ASCII white space."""
    return runs(~WHITE[data], offs)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges first[i]..first[i + 1]."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and the first of each text.

    A text of 1 to k - 1 words has one shingle of all its words; a text without words has none.
    """
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=begin[1:])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n)
    end = np.repeat(first[1:], n)
    out = np.zeros(len(at), np.uint64)
    c = 1
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for j in range(k):
        c = c * 0xC2B2AE3D27D4EB4F % (1 << 64) | 1
        out += np.where(at + j < end, padded[at + j], np.uint64(0)) * np.uint64(c)
    return mix(out), begin


@lru_cache(8)
def constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n odd multipliers and n addends of the multiply-shift universal family."""
    r = np.random.Generator(np.random.PCG64(seed))
    top = np.iinfo(np.uint64).max
    return r.integers(0, top, n, np.uint64) | np.uint64(1), r.integers(0, top, n, np.uint64)
