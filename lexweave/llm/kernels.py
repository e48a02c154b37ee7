"""Vectorised text kernels: words and their 64-bit hashes straight from UTF-8 bytes.

All word classes used by the operators are decided by single bytes (every
non-ASCII character belongs to a word), so a byte table finds words without
decoding.  A hash is a polynomial over the word's bytes modulo 2**64 with a
random value per byte, mixed at the end; equality of hashes stands for equality
of words with a chance of error near 2**-64 per pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18  #: bytes that one pass over arrays takes at most, unless one word is longer


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker function that hands freed memory back when its task ends, since workers outlive tasks."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return whole


def byte_class(chars: str, negate: bool = False) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return ~table if negate else table


#: Words are runs of anything but ASCII white space.
NOT_SPACE = byte_class(" \t\n\x0b\x0c\r", negate=True)
#: Words are runs of digits, lower-case letters and everything beyond ASCII.
ALNUM = byte_class("0123456789abcdefghijklmnopqrstuvwxyz")
ALNUM[128:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SHINGLE = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, kept for reuse up to one block."""
    if "up" not in _powers or len(_powers["up"]) < min(n, 2 * BLOCK):
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(2 * BLOCK, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    if n <= 2 * BLOCK:
        return _powers["up"], _powers["down"]
    out = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def texts(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Slices (first row, UTF-8 texts) of at most ``limit`` bytes or one row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else None
    first, size, part = 0, 0, []
    for i in range(len(column)):
        one = bytes(view[at[i] : at[i + 1]]) if valid is None or valid[i] else b""
        if part and size + len(one) > limit:
            yield first, part
            first, size, part = i, 0, []
        part.append(one)
        size += len(one) + 1
    yield first, part


def joined(part: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer with a space after each, and where each begins (one more: the end)."""
    buf = np.frombuffer(b" ".join(part) + b" ", np.uint8)
    starts = np.zeros(len(part) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in part], out=starts[1:])
    return (LOWER[buf] if lower else buf), starts


def words(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer that ends with a separator."""
    inside = table[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside.size and inside[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by blocks of whole words."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        base, top = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(top - base + 1)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum(_BYTE[buf[base:top]] * up[: top - base], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each ``k`` consecutive words; fewer words are one shingle; none give none."""
    n = len(h)
    if n == 0:
        return h
    m = min(k, n)
    total = h[: n - m + 1] * _SHINGLE[0]
    for j in range(1, m):
        total = total + h[j : n - m + 1 + j] * _SHINGLE[j]
    return mix(total + np.uint64(m))


def word_counts(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text, the index of its first word (one more: the number of words)."""
    return np.searchsorted(starts, bounds)
