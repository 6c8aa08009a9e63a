"""Words, shingles and hashes of whole texts, in numpy, for Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_ODD = 0x9E3779B97F4A7C15
#: Bytes of a word that are scrambled as numbers.
LONG_WORD = 64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x + U((seed * 0xD1342543DE82EF95 + _ODD) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(256, dtype=U), 77)


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base modulo 2**64, and of its inverse."""
    base = _ODD
    inverse = pow(base, -1, 2**64)
    out = []
    for b in (base, inverse):
        p = np.full(n + 1, b, U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the bytes' random values times powers, and inverse powers: any span's hash in O(1).

    Different spans can be built that share such a hash, so it groups spans, and equality is decided by other means.
    """
    n = 1 << max(19, (len(data) - 1).bit_length() if len(data) else 0)
    power, inverse = powers(n)
    values = _byte_values()[data]
    values *= power[: len(data)]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(values, out=sums[1:])
    return sums, inverse


def spans(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end)."""
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each word: runs of bytes other than 0x20 and 0x09-0x0D, never across rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    before |= edge[:-1]
    start = np.flatnonzero(inside & before)
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    after |= edge[1:]
    end = np.flatnonzero(inside & after) + 1
    row = np.searchsorted(offsets[1:], start, side="right")
    return row, start, end


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words [start, end): scrambled eight bytes at a time, the rest of a long one by xxHash."""
    padded = np.concatenate([_LOWER[data] if lower else data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = end - start
    out = mix(size.astype(U), 31)
    todo = np.flatnonzero(size > 0)
    for at in range(0, LONG_WORD, 8):
        left = np.minimum(size[todo] - at, 8).astype(U)
        part = eight[start[todo] + at] << (U(64) - (left << U(3)))
        out[todo] = mix(out[todo] ^ part, at + 41)
        todo = todo[size[todo] > at + 8]
        if not len(todo):
            return out
    out[todo] = mix(out[todo] ^ np.array([xxhash.xxh3_64_intdigest(padded[start[i] + LONG_WORD : end[i]].data) for i in todo.tolist()], U), 91)
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each word; lower: A-Z count as a-z."""
    row, start, end = words(data, offsets)
    return row, hashed(data, start, end, lower)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle of width words, sorted by row and hash, and each row's first index.

    A row of fewer words, but at least one, has its whole sequence as one shingle; a row without words none.
    """
    n = len(offsets) - 1
    row, h = word_hashes(data, offsets)
    count = np.bincount(row, minlength=n)
    if len(h) >= width:
        full = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
        value = np.full(len(full), width, U)
        for i in range(width):
            value = mix(value + h[full + i], i + 1)
        whole = row[full]
    else:
        value, whole = np.zeros(0, U), np.zeros(0, row.dtype)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.cumsum(count) - count
        extra = count[short].astype(U)
        for i in range(width - 1):
            has = count[short] > i
            extra[has] = mix(extra[has] + h[first[short[has]] + i], i + 1)
        value, whole = np.concatenate([value, extra]), np.concatenate([whole, short])
    order = np.argsort(value)
    order = order[np.argsort(whole[order].astype(np.uint16 if n < 65536 else np.int64), kind="stable")]
    value, whole = value[order], whole[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (whole[1:] != whole[:-1])
        value, whole = value[new], whole[new]
    at = np.searchsorted(whole, np.arange(n + 1))
    return whole, value, at
