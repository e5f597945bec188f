"""Whole texts as numpy byte blocks, for vectorised work inside tasks.

A block joins the UTF-8 bytes of a few documents with newlines between them.
Substrings are hashed by differences of one running polynomial sum, so that a
block costs a few array passes and no Python loop over words or bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
#: The same table with A-Z keyed like a-z.
LOWER_KEYS = BYTE_KEYS.copy()
LOWER_KEYS[65:91] = BYTE_KEYS[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE), np.full(size, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(BLOCK_BYTES * 2, 1 << int(n).bit_length()))


class Hashes:
    """Hashes of substrings [start, end) of one block."""

    def __init__(self, block: np.ndarray, keys: np.ndarray = BYTE_KEYS):
        up, self.down = powers(len(block) + 1)
        self.sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(keys[block] * up[: len(block)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scrambled with the length, so that a prefix never hashes like its longer string."""
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw ^ ((end - start).astype(np.uint64) * _U(0xA0761D6478BD642F)))

    def fixed(self, size: int) -> np.ndarray:
        """Hash of the size bytes from each position on."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


class Block:
    """Rows [first, last) of a batch as one array, with where each document starts and ends in it."""

    def __init__(self, first: int, texts: list[bytes]):
        self.first, self.last = first, first + len(texts)
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes

    def words(self, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document (from 0 in the block) of each word."""
        gap = space[self.bytes]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        return start, end, np.searchsorted(self.ends, start, side="right")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive blocks of at most so many bytes, or of one longer document; texts is emptied meanwhile."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield Block(first, texts[first:i])
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield Block(first, texts[first:])


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, with the end after the last one."""
    if not len(values):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
