"""Vectorised text work on Arrow string columns: words, word hashes and shingle sets by numpy, no loop over words.

Texts are handled whole, in slices of some documents at a time; a slice is bounded by bytes, and one
longer text is a slice of its own. A word is a run of bytes other than space, tab, LF, VT, FF and CR;
these are single bytes in UTF-8, so byte work is exact for any script.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
RAW = np.arange(256, dtype=np.uint8)
#: Letters and digits by kind; every other byte stays itself.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 97, 65, 48, 97

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(z: np.ndarray) -> np.ndarray:
    """Finalizer of the public SplitMix64 generator."""
    z = z ^ (z >> np.uint64(30))
    z = z * _M1
    z ^= z >> np.uint64(27)
    z *= _M2
    z ^= z >> np.uint64(31)
    return z


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """Odd multipliers for positions in a word."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(256, 1 << int(n).bit_length())
        _POWERS = mix(np.arange(7, 7 + size, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    return _POWERS


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of rows in bytes); a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row of each word); rows never share a word."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~IS_SPACE[buf]
    first, last = np.empty_like(ink), np.empty_like(ink)
    first[0], last[-1] = True, True
    np.logical_not(ink[:-1], out=first[1:])
    np.logical_not(ink[1:], out=last[:-1])
    full = off[1:] > off[:-1]
    first[off[:-1][full]] = True
    last[off[1:][full] - 1] = True
    starts, ends = np.flatnonzero(ink & first), np.flatnonzero(ink & last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = RAW) -> np.ndarray:
    """64-bit hash of every word, its bytes folded by a table first."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum()), dtype=np.int64)
    pos = at - np.repeat(first, lens)
    at = pos + np.repeat(starts, lens)
    return mix(np.add.reduceat(BYTE_HASH[fold[buf[at]]] * powers(int(lens.max()))[pos], first))


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, A-Z lower-cased, as sorted hashes; fewer words make one shingle.

    Returns (hashes, offsets): row i has hashes[offsets[i]:offsets[i + 1]].
    """
    n = len(off) - 1
    starts, ends, row = word_spans(buf, off)
    h = word_hashes(buf, starts, ends, LOWER)
    count = np.bincount(row, minlength=n)
    weight = powers(2 * k + 2)
    runs = max(0, len(h) - k + 1)
    s = np.zeros(runs, np.uint64)
    for j in range(k):
        s += h[j : j + runs] * weight[j]
    inside = row[:runs] == row[k - 1 :][:runs] if runs else np.zeros(0, bool)
    s, owner = s[inside], row[:runs][inside]
    small = np.flatnonzero((count > 0) & (count < k))
    if len(small):
        is_small = np.zeros(n, bool)
        is_small[small] = True
        pick = is_small[row]
        begin = np.cumsum(count) - count
        place = np.arange(len(row)) - begin[row]
        part = h[pick] * weight[place[pick]]
        lens = count[small]
        whole = np.add.reduceat(part, np.cumsum(lens) - lens) + weight[k + lens]
        s, owner = np.concatenate([s, whole]), np.concatenate([owner, small])
        order = np.argsort(owner, kind="stable")
        s, owner = s[order], owner[order]
    s = mix(s)
    size = np.bincount(owner, minlength=n)
    edge = np.concatenate([[0], np.cumsum(size)])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a > 1:
            s[a:b].sort()
    if len(s):
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
        s, owner = s[new], owner[new]
        edge = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    return s, edge
