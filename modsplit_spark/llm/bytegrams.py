"""Hashed byte n-grams (or code point n-grams) of many texts at once, as numpy arrays over one buffer."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
RELEASE_BYTES = 8 << 20
#: Separators of words: white space and marks that end words; others stay, as they stand in for letters.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[np.frombuffer(b"\x00\t\n\v\f\r ,.;:?\"()[]{}|", np.uint8)] = True


def release_memory() -> None:
    """Freed memory goes back to the system. Workers live on between tasks and would keep their peak for good."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def parts(batches, rows: int = 512) -> Iterator:
    """Arrow batches cut to at most ``rows`` rows, so that a worker holds few texts as Python objects at a time.

    Freed memory is given back after every ``RELEASE_BYTES`` of batches and at the end of a task."""
    seen = 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        seen += batch.nbytes
        if seen >= RELEASE_BYTES:
            batch, seen = None, 0
            release_memory()
    batch = None
    release_memory()


def slices(texts: list[bytes] | list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``SLICE_BYTES`` in all; a longer text is alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > SLICE_BYTES:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One array with a space before each text and after the last, and the texts' first positions (one more at the end)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8), np.concatenate([[0], np.cumsum(lengths)]) + 1


def grams(a: np.ndarray, sizes: range, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(n, buckets)``: the bucket of the n bytes from each position on; the last n-1 positions have none."""
    x = a.astype(np.uint32) + np.uint32(1)
    h = np.zeros(len(x), np.uint32)
    for n in range(1, sizes.stop):
        if len(x) < n:
            yield n, np.zeros(0, np.uint32)
            continue
        h = h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :]
        if n >= sizes.start:
            g = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            g ^= g >> np.uint32(13)
            yield n, (g * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)


def joined_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As ``joined``, of code points."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(lengths)]) + 1


def words(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last positions of the words of a joined array."""
    inside = np.concatenate([[False], ~SEPARATORS[np.minimum(a, 255)], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]
