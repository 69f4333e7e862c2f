"""Counts of hashed character n-grams and words per text, computed over Arrow batches."""

from __future__ import annotations

from functools import cache

import numpy as np

from .grams import words
from .shared import mixed


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def lowered(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, and the texts' bounds in them."""
    text = str(raw.tobytes(), "utf-8")
    small = text.lower()
    if len(small) == len(text):
        starts = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        return np.frombuffer(small.encode("utf-32-le"), np.uint32), starts[offsets]
    each = [str(raw[a:b].tobytes(), "utf-8").lower() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.frombuffer("".join(each).encode("utf-32-le"), np.uint32), np.append(0, np.cumsum([len(x) for x in each]))


def letter_counts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(_letters()[points]))[bounds])


def gram_counts(points: np.ndarray, bounds: np.ndarray, dims: int, sizes: tuple[int, ...] = (2, 3)) -> np.ndarray:
    """texts x dims counts of hashed n-grams; other characters than letters count as one blank, two blanks
    do not stand in a gram."""
    letter = _letters()[points]
    value = np.where(letter, points, 32).astype(np.uint64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.zeros((len(bounds) - 1) * dims, np.int64)
    for n in sizes:
        if len(points) < n:
            continue
        last = len(points) - n + 1
        use = (row[:last] == row[n - 1 :]) & letter[:last]
        key = np.full(last, n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                key = key * np.uint64(0x110003) + value[k : k + last]
                if k:
                    use &= letter[k : k + last] | letter[k - 1 : k - 1 + last]
            key = mixed(key[use]) % np.uint64(dims)
        out += np.bincount(row[:last][use] * dims + key.astype(np.int64), minlength=len(out))
    return out.reshape(-1, dims)


def word_counts(raw: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """texts x dims counts of hashed words."""
    word, bounds = words(raw, offsets)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.bincount(row * dims + (word % np.uint64(dims)).astype(np.int64), minlength=(len(bounds) - 1) * dims).reshape(-1, dims)
