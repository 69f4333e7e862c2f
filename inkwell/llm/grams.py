"""Hashes of words, word shingles and byte windows, computed over whole Arrow batches at once."""

from __future__ import annotations

from functools import cache

import numpy as np

from .shared import mixed

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD1342543DE82EF95)
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)


@cache
def _powers(base: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64."""
    return _powers(int(base), 1 << max(16, int(n - 1).bit_length() if n > 1 else 1))[:n]


def prefix(raw: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of polynomial hashes of bytes, modulo 2**64."""
    out = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTES[raw] * powers(BASE, len(raw)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the byte spans; equal bytes, equal hashes, wherever they stand."""
    with np.errstate(over="ignore"):
        return mixed((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (runs without white space) and, per text, where its words begin and end."""
    inner = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = inner.copy()
    start[1:] &= ~inner[:-1] | edge[1:-1]
    end = inner
    end[:-1] &= ~inner[1:] | edge[1:-1]
    at, to = np.flatnonzero(start), np.flatnonzero(end) + 1
    return spans(prefix(raw), at, to), np.searchsorted(at, offsets)


def shingles(word: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words in each text, and their bounds by text.

    A text of fewer words has one shingle, its whole word sequence; a text without words has none.
    """
    count = np.diff(bounds)
    number = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    to = np.append(0, np.cumsum(number))
    out = np.zeros(to[-1], np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, width + 1):
            rows = np.flatnonzero(count >= width) if n == width else np.flatnonzero(count == n)
            if not len(rows):
                continue
            size = number[rows]
            place = np.repeat(to[:-1][rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            first = np.repeat(bounds[:-1][rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            value = word[first].copy()
            for k in range(1, n):
                value = value * STEP + word[first + k]
            out[place] = mixed(value + np.uint64(n))
    return out, to


def reduced(values: np.ndarray, bounds: np.ndarray, how: np.ufunc, empty: int) -> np.ndarray:
    """how over the values of each text; empty for a text without values."""
    out = np.full(len(bounds) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = how.reduceat(values, bounds[full])
    return out


def min_hashes(shingle: np.ndarray, bounds: np.ndarray, functions: int, seed: int = 1) -> np.ndarray:
    """texts x functions 32-bit minima under so many hash functions."""
    odd = mixed(np.arange(seed, seed + 2 * functions, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros((len(bounds) - 1, functions), np.int32)
    with np.errstate(over="ignore"):
        for k in range(functions):
            low = reduced((shingle ^ odd[functions + k]) * odd[k], bounds, np.minimum, 0)
            out[:, k] = (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def sequence_digests(word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """texts x 16 bytes that name each text's word sequence."""
    n = np.diff(bounds)
    place = np.arange(len(word)) - np.repeat(bounds[:-1], n)
    out = np.zeros((len(n), 2), np.uint64)
    with np.errstate(over="ignore"):
        for k, (base, salt) in enumerate(((BASE, 1), (STEP, 2))):
            out[:, k] = mixed(reduced(mixed(word + np.uint64(salt)) * powers(base, int(n.max(initial=0)) + 1)[place], bounds, np.add, 0) + n.astype(np.uint64))
    return out.view(np.uint8).reshape(len(n), 16)
