"""Arrow string columns as flat bytes, and vectorised hashing over them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 of all rows back to back; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (or one row), so scratch arrays stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def grams(raw: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` bytes (at most 16) from every place that has so many left."""
    size = max(0, len(raw) - n + 1)
    words = []
    for low in range(0, n, 8):
        word = np.zeros(size, U64)
        for k in range(low, min(n, low + 8)):
            word |= raw[k : k + size].astype(U64) << U64(8 * (k - low))
        words.append(word)
    out = mix(words[0] + U64(n))
    return out if len(words) == 1 else mix(out * _BASE + words[1])


PRIME = U64((1 << 61) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> U64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def mulmod(a, b) -> np.ndarray:
    """Products modulo 2**61 - 1, of numbers below it."""
    low31, low30 = U64((1 << 31) - 1), U64((1 << 30) - 1)
    ah, al, bh, bl = a >> U64(31), a & low31, b >> U64(31), b & low31
    middle = al * bh + ah * bl
    return _reduced(ah * bh * U64(2) + (middle >> U64(30)) + ((middle & low30) << U64(31)) + al * bl)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo the prime."""
    out = []
    for base in (int(_BASE) % int(PRIME), pow(int(_BASE), -1, int(PRIME))):
        got, size = np.ones(n, U64), 1
        while size < n:
            more = min(size, n - size)
            got[size : size + more] = mulmod(got[:more], U64(pow(base, size, int(PRIME))))
            size += more
        out.append(got)
    return out[0], out[1]


class Rolling:
    """Hashes of any short byte ranges of one buffer from prefix sums: a polynomial modulo
    the prime 2**61 - 1.  Equal content, equal hash; ranges of different content of L bytes
    have equal hashes for L in 2**61 bases at most."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(1 << max(19, int(len(raw)).bit_length()))
        byte = raw.astype(U64) + U64(1)
        self.low, self.high = np.zeros(len(raw) + 1, U64), np.zeros(len(raw) + 1, U64)
        np.cumsum(byte * (up[: len(raw)] & U64(0xFFFFFFFF)), out=self.low[1:])
        np.cumsum(byte * (up[: len(raw)] >> U64(32)), out=self.high[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of ranges of at most 2**20 bytes: their sums then fit in 64 bits."""
        value = _reduced((self.low[ends] - self.low[starts]) % PRIME + mulmod((self.high[ends] - self.high[starts]) % PRIME, U64(1 << 32)))
        return mix(mulmod(value, self.down[starts]) + (ends - starts).astype(U64) * _BASE)


SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): maximal runs of bytes other than ASCII white space, none
    across rows; ``first`` has the index of each row's first word (length rows + 1)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACES[raw]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    cut = inner[(inner > 0) & (inner < len(raw))]
    start[cut] |= word[cut]
    end[cut - 1] |= word[cut - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offsets)
