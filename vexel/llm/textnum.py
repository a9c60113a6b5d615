"""Vectorised text primitives shared by the operators of this subpackage.

A batch of texts becomes one byte array; words, lines and n-grams are then found
by array operations over the whole batch, so the Python cost is per batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Byte classes: letters, digits and every byte of a multi-byte character make words.
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def joined(texts) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the n+1 offsets between them; a null counts as empty."""
    column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, type=pa.large_string(), from_pandas=True)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def spans(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``, also cut at the offsets ``cuts``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    inner = cuts[(cuts > 0) & (cuts < n)]
    start[inner] = inside[inner]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[inner - 1] = inside[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_PIECE = 1 << 20


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are ascending and disjoint."""
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    at = 0
    while at < len(starts):
        lo = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, lo + _PIECE, side="right")))
        s, e = starts[at:upto] - lo, ends[at:upto] - lo
        piece = data[lo : lo + e[-1]].astype(np.uint64) + _U(1)
        pw = powers(len(piece), _BASE)
        h = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(piece * pw[:-1], out=h[1:])
        inv = powers(len(piece), _INV)
        out[at:upto] = mix((h[e] - h[s]) * inv[s] + (e - s).astype(np.uint64))
        at = upto
    return out


def words(texts, lower: bool = True):
    """(word hashes, owner of each word, first word of each text with a final total, byte starts, byte ends, data, offsets)."""
    data, at = joined(texts)
    s, e = spans(WORD[data], at)
    low = LOWER[data] if lower else data
    h = span_hashes(low, s, e)
    first = np.searchsorted(s, at)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return h, owner, first, s, e, data, at


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each text, and the first window of each text with a final total.

    A text of 1 to n-1 words has one window of all its words; a text without words has none.
    """
    count = np.diff(first)
    windows = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    at = np.concatenate(([0], np.cumsum(windows)))
    total = int(at[-1])
    owner = np.repeat(np.arange(len(count)), windows)
    pos = np.arange(total) - at[owner] + first[owner]
    out = np.zeros(total, dtype=np.uint64)
    end = first[owner + 1]
    q = _U(0xD6E8FEB86659FD93)
    for k in range(n):
        p = pos + k
        ok = p < end
        out = out * q + np.where(ok, h[np.minimum(p, len(h) - 1)], _U(k)) if total else out
    return mix(out), at
