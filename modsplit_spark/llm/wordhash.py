"""64-bit hashes of all words of many texts at once, as numpy arrays over one buffer."""

from __future__ import annotations

import numpy as np

#: White space that separates words: blank and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20)
BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Bytes that are hashed together; a longer word is alone.
BLOCK_BYTES = 1 << 17
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^(n-1) and their inverses, modulo 2^64."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        n = max(n, 1 << 16)
        one = np.uint64(1)
        known = _POWERS[base] = tuple(np.multiply.accumulate(np.concatenate([[one], np.full(n - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
    return known


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def range_sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums from which ``range_hash`` takes the hash of any range."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of the values from ``start`` to before ``end``, the same wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(base, len(sums))[1][start] + (end - start).astype(np.uint64))


def _byte_hashes(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word's bytes, block by block: eight bytes a byte of a whole chunk, several times over, would be most of a worker's memory."""
    out, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK_BYTES, "right")))
        first = start[i]
        out[i:j] = range_hash(range_sums(BYTE[a[first : end[j - 1]]], BASES[0]), start[i:j] - first, end[i:j] - first, BASES[0])
        i = j
    return out


def word_hashes(texts: list[bytes], fold: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hash, text number, first and past-the-last byte of every word, and the buffer they refer to.

    ``fold`` is a table of 256 bytes applied first (to lower case, or to turn marks into blanks)."""
    buffer = b"\n".join(texts) + b"\n"
    if fold is not None:
        buffer = buffer.translate(fold)
    a = np.frombuffer(buffer, np.uint8)
    inside = np.zeros(len(a) + 1, bool)
    np.logical_not(SPACE[a], out=inside[1:])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    first = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    owner = np.searchsorted(first, start, "right") - 1
    return _byte_hashes(a, start, end), owner, start, end, buffer
