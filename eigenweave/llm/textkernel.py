"""Vectorised tokenising and hashing of Arrow string columns.

Works on the UTF-8 buffer of a whole Arrow batch with NumPy: no Python object is made per text or per
word. Words are runs of bytes outside ASCII white space (or of a given byte class); ASCII upper case
hashes like lower case. A word's 64-bit hash is a polynomial over random byte values modulo 2**64, from
one prefix sum per block, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=U)
_BYTE[65:91] = _BYTE[97:123]
_BASE = int(_RNG.integers(0, 2**64, dtype=U)) | 5
_INVERSE = pow(_BASE, -1, 2**64)
_SHINGLE = _RNG.integers(0, 2**64, 64, dtype=U) | U(1)
_BLOCK = 1 << 17

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of the other word class: digits, letters and everything outside ASCII.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[list(range(0x00, 0x30)) + list(range(0x3A, 0x41)) + list(range(0x5B, 0x61)) + list(range(0x7B, 0x80))] = True


def _table(base: int, n: int) -> np.ndarray:
    out = np.ones(1, U)
    step = base
    while len(out) < n:  # doubling: out * base**len(out)
        out = np.concatenate([out, out * U(step)])
        step = step * step % 2**64
    return out


_POW, _INV = _table(_BASE, _BLOCK), _table(_INVERSE, _BLOCK)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if n > len(_POW):
        return _table(_BASE, n), _table(_INVERSE, n)
    return _POW, _INV


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if offs is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of a single row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, j
        i = j


def words(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of the rows, and the first word's index of every row (one more)."""
    a, b = int(offsets[0]), int(offsets[-1])
    inside = ~gap[buf[a:b]]
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    cut = np.zeros(b - a + 1, bool)
    cut[offsets - a] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start) + a, np.flatnonzero(end) + a + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, i, n = np.empty(len(starts), U), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        power, inverse = _powers(b - a)
        total = np.zeros(b - a + 1, U)
        np.cumsum(_BYTE[buf[a:b]] * power[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * inverse[s]
        i = j
    return mix64(out)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words of each row, in order; a shorter row gives its whole sequence as one.

    Returns the hashes and the first one's index of every row (one more).
    """
    n_words = np.diff(first)
    count = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    at = np.zeros(len(first), np.int64)
    np.cumsum(count, out=at[1:])
    n = len(hashes)
    total = np.zeros(max(n - width + 1, 0), U)
    for k in range(width):
        if len(total):
            total += hashes[k : n - width + 1 + k] * _SHINGLE[k]
    out = np.empty(int(at[-1]), U)
    long = n_words >= width
    if long.all():
        keep = np.ones(n, bool)
    else:
        keep = np.repeat(long, n_words)
    # the last width - 1 words of a row start no shingle
    for k in range(1, width):
        idx = first[1:][long] - k
        keep[idx] = False
    starts = np.flatnonzero(keep)
    row_of = np.zeros(len(out), bool)
    short = np.flatnonzero((n_words > 0) & ~long)
    row_of[at[:-1][short]] = True
    out[~row_of] = total[starts]
    for r in short:
        h = hashes[first[r] : first[r + 1]]
        out[at[r]] = np.concatenate([h * _SHINGLE[: len(h)], _SHINGLE[32 + len(h) : 33 + len(h)]]).sum(dtype=U)
    return mix64(out), at
