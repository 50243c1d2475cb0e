"""Word shingles of flat text columns as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .flat import U64, mix, words

WIDTH = 5
_STEP = [U64((0xA0761D6478BD642F * (2 * k + 3)) & 0xFFFFFFFFFFFFFFFF | 1) for k in range(WIDTH)]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash a word: the sum of a random value for each (byte, place in the word).  No
    polynomial, so strings built against a public base collide no sooner than others."""
    place = np.arange(len(raw), dtype=np.int64)
    size = ends - starts
    inside = np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    value = np.zeros(len(raw) + 1, U64)
    value[inside + 1] = mix((raw[inside].astype(U64) | ((place[inside] - np.repeat(starts, size)).astype(U64) << U64(8))) * U64(0xD1B54A32D192ED03) + U64(1))
    np.cumsum(value, out=value)
    return mix(value[ends] - value[starts] + size.astype(U64))


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in text order, first): ``first`` has where each row's shingles begin.

    Words are runs of bytes other than ASCII white space.  A text of one to ``width - 1``
    words has one shingle, all of it; a wordless one has none.
    """
    starts, ends, first = words(raw, offsets)
    n = np.diff(first)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    h = word_hashes(raw, starts, ends)
    got = np.zeros(len(h), U64)
    for k in range(width):
        got[: len(h) - k] += mix(h[k:] + U64(k)) * _STEP[k]
    short = np.flatnonzero((n > 0) & (n < width))
    per = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(per)])
    row = np.repeat(np.arange(len(n)), per)
    where = first[row] + np.arange(at[-1]) - at[row]
    out = got[where]
    for r in short:  # sums of fewer words, marked with their number
        own = h[first[r] : first[r + 1]]
        out[at[r]] = sum((mix(own[k : k + 1] + U64(k)) * _STEP[k] for k in range(len(own))), np.zeros(1, U64))[0] + U64(len(own))
    return mix(out), at


def counted(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, times): the multiset of each row's shingles, sorted by row and hash."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return r[at], h[at], np.diff(np.append(at, len(h)))
