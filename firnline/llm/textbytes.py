"""Vectorised work on the UTF-8 bytes of a column of texts: slices, words and 64-bit hashes.

A segment's hash depends on its bytes alone, so equal segments of any rows and executors hash alike. Every eight bytes
pass a mixing step of their own: no family of texts collides by its structure, as under polynomials modulo 2**64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Segments of more bytes are hashed by BLAKE2, one by one.
LONG = 256
_HEAD = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

#: ASCII white space, as in [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the n + 1 offsets of the texts in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 4 << 20):
    """Ranges of rows with about `most` bytes each; a longer row has a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, the first byte lowest; bytes beyond the end are 0."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def segments(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each [start, end): eight at a time, each mixed into what came before; BLAKE2 for long ones."""
    size = end - start
    out = mix(size.astype(np.uint64) * BASE + np.uint64(1))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    rows = np.flatnonzero((size > 0) & (size <= LONG))
    at, left, h, words = start[rows], size[rows], out[rows], eights(buf)
    while len(rows):
        h = mix(h ^ (words[at] & _HEAD[np.minimum(left, 8)]) * BASE)
        more = left > 8
        out[rows[~more]] = h[~more]
        rows, at, left, h = rows[more], at[more] + 8, left[more] - 8, h[more]
    return out


def same(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, at_once: int = 1 << 15) -> bool:
    """Whether the segments from a on hold the bytes of those from b on, all of them; `at_once` are compared at a time."""
    words = eights(buf)
    todo = np.flatnonzero(a != b)
    for lo in range(0, len(todo), at_once):
        rows = todo[lo : lo + at_once]
        x, y, left = a[rows], b[rows], size[rows]
        for i in np.flatnonzero(left > LONG).tolist():
            if not np.array_equal(buf[x[i] : x[i] + left[i]], buf[y[i] : y[i] + left[i]]):
                return False
        x, y, left = (v[left <= LONG] for v in (x, y, left))
        while len(x):
            if ((words[x] ^ words[y]) & _HEAD[np.minimum(left, 8)]).any():
                return False
            more = left > 8
            x, y, left = x[more] + 8, y[more] + 8, left[more] - 8
    return True


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true values within one text, and each text's first run: n + 1 positions."""
    edge = np.empty(len(inside) + 1, bool)
    edge[0], edge[-1] = True, True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    keep = inside[at[:-1]] if len(at) > 1 else np.zeros(0, bool)
    start, end = at[:-1][keep], at[1:][keep]
    return start, end, np.searchsorted(start, offsets)


def gram(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values; len(h) - n + 1 of them, none if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out ^= out >> np.uint64(32)
        out *= BASE
        out += h[i : i + m]
    return mix(out)


def row_ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] of them) for each i, end to end."""
    total = int(count.sum())
    out = np.arange(total, dtype=np.int64)
    before = np.cumsum(count) - count
    return out + np.repeat(first - before, count)
