"""Words of whole texts as NumPy arrays, a bounded slice of rows at a time.

A word is a run of characters other than space and \\x09-\\x0D. Hashes are sums of
random 64-bit numbers per byte (or word), each times a power of an odd number,
so the hash of any stretch is a difference of two running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers so that sums of them behave like random ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _bytes_table(lane: int) -> np.ndarray:
    return np.random.default_rng([20, lane]).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            m = max(n, SLICE_BYTES + 64)
            for name, b in (("_up", self.base), ("_down", self.inverse)):
                steps = np.full(m, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self._up[:n], self._down[:n]


_LETTERS = (Powers(0x9E3779B97F4A7C13), Powers(0xD1342543DE82EF93))
_WORDS = (Powers(0xC2B2AE3D27D4EB4F | 3), Powers(0xA0761D6478BD642B))


@dataclass
class Words:
    """Words of some rows: rows `first` to `first + n`; word i of row r is at bounds[r] + i."""

    first: int
    n: int
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self, lane: int = 0) -> np.ndarray:
        up, down = _LETTERS[lane].upto(len(self.raw) + 1)
        sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(_bytes_table(lane)[self.raw] * up[: len(self.raw)], dtype=np.uint64, out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.bounds))


class Stretches:
    """Hashes of stretches of consecutive words, from the hashes of the words."""

    def __init__(self, hashes: np.ndarray, lane: int = 0):
        self.up, self.down = _WORDS[lane].upto(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def read_words(column: pa.Array | pa.ChunkedArray, lower: bool = False, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a text column (null: none), rows together up to about `slice_bytes`."""
    texts = column.to_pylist()
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        held.append(data)
        size += len(data) + 1
        if size >= slice_bytes or i == len(texts) - 1:
            yield _split(first, held, lower)
            first, held, size = i + 1, [], 0


def _split(first: int, texts: list[bytes], lower: bool) -> Words:
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if lower:
        raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(~inside & before)
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=edges[1:])
    return Words(first, len(texts), raw, starts, ends, np.searchsorted(starts, edges))
