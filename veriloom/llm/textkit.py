"""Vectorised word hashing for Arrow batches: the shared ground of the operators that work on word n-grams.

Words are runs of bytes other than space and tab to carriage return, after A-Z is lower-cased; their 64-bit hashes come
from prefix sums of a polynomial, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Bytes of text worked on at once; a longer text is worked on alone.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = np.asarray(x, dtype=U)
    if x.ndim == 0:
        return mix(x.reshape(1))[0]
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, dtype=U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Keeps tables of powers as long as the longest block so far."""

    def __init__(self, separators: bytes = b" \t\n\x0b\x0c\r"):
        self.is_word = np.ones(256, dtype=bool)
        self.is_word[list(separators)] = False
        self.lower = np.arange(256, dtype=U) + U(1)
        self.lower[65:91] += U(32)
        self.up = self.down = np.zeros(0, dtype=U)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts data[offsets[i]:offsets[i + 1]]: start, end and hash of every word, and how many words lie before each text (one more than texts)."""
        n = len(data)
        if n > len(self.up):
            self.up, self.down = powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = self.is_word[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(self.lower[data] * self.up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(U))
        return starts, ends, hashes, np.searchsorted(starts, offsets)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; nulls count as empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of texts of about `size` bytes: first and last + 1 row, bytes, offsets."""
    data, offsets = texts(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words within a text and the text it is in; a text of fewer words, but not none, has its whole sequence as one."""
    n = len(hashes)
    factors = mix(np.arange(1, k + 1, dtype=U) * U(_BASE)) | U(1)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    if n >= k:
        run = np.zeros(n - k + 1, dtype=U)
        for j in range(k):
            run += hashes[j : n - k + 1 + j] * factors[j]
        whole = owner[: n - k + 1] == owner[k - 1 :]
        run, at = mix(run[whole]), owner[: n - k + 1][whole]
    else:
        run, at = np.zeros(0, U), np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        extra = np.array([mix((hashes[first[i] : first[i + 1]] * factors[: count[i]]).sum(dtype=U) + U(count[i])) for i in few], dtype=U)
        run, at = np.concatenate([run, extra]), np.concatenate([at, few])
        order = np.argsort(at, kind="stable")
        run, at = run[order], at[order]
    return run, at
