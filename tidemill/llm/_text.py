"""Vectorised tokenising and hashing of UTF-8 text columns, straight from Arrow buffers.

A word is a longest run of ``[^\\x20\\x09-\\x0D]``; the separators are single ASCII bytes, so the work is
done on bytes. Hashes have 64 bits and treat A-Z as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = _U(0xD6E8FEB86659FD93)
_LENGTH = _U(0xA0761D6478BD642F)

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 2**64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each."""
    return _powers(1 << max(20, (n - 1).bit_length()))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null rows are empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


def pieces(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes; a longer text is a run alone."""
    if not len(column):
        return
    data, offsets = buffers(column)
    a = 0
    while a < len(column):
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), len(column))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one entry more than rows)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[:-1][offsets[:-1] < n]
    first[cut] = inside[cut]
    cut = offsets[1:][offsets[1:] > 0] - 1
    last[cut] = inside[cut]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by prefix sums of a polynomial."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _LENGTH)


def long_parts(data: np.ndarray, carry: int = 0, most: int = 1 << 22) -> Iterator[np.ndarray]:
    """The bytes of one long text in parts of about ``most`` bytes cut at separators; each begins ``carry`` words before the last one's end.

    A word longer than a part is not cut.
    """
    a, n = 0, len(data)
    while True:
        b = min(n, a + most)
        while b < n and not SPACE[data[b]]:
            here = np.flatnonzero(SPACE[data[b : b + most]])
            b = b + int(here[0]) if len(here) else min(n, b + most)
        yield data[a:b]
        if b >= n:
            return
        back = b
        if carry:
            look = 1 << 12
            while True:
                low = max(a + 1, b - look)
                starts = np.flatnonzero(SPACE[data[low - 1 : b - 1]] & ~SPACE[data[low:b]]) + low
                if len(starts) >= carry or low == a + 1:
                    break
                look *= 8
            back = int(starts[-carry]) if len(starts) >= carry else a
            if back == a:  # fewer words than are carried
                back, most = a, 2 * most
        a = back


def _long_word(data: np.ndarray) -> int:
    """The sum that ``word_hashes`` takes of a word, for one longer than a part."""
    up, _ = powers(1 << 22)
    total, factor, step = 0, 1, pow(_BASE, 1 << 22, 2**64)
    for a in range(0, len(data), 1 << 22):
        part = data[a : a + (1 << 22)]
        total = (total + factor * int(np.sum(_BYTE[part] * up[: len(part)], dtype=np.uint64))) % 2**64
        factor = factor * step % 2**64
    return total


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each row the index of its first word (one entry more than rows).

    A long text, which is a run of rows alone, is hashed part by part, so that only the hashes are held whole.
    """
    if len(data) <= 1 << 23 or len(offsets) != 2:
        starts, ends, first = words(data, offsets)
        return word_hashes(data, starts, ends), first
    out = []
    for part in long_parts(data):
        if len(part) <= 1 << 24:
            starts, ends, _ = words(part, np.array([0, len(part)]))
            out.append(word_hashes(part, starts, ends))
            continue
        for a in _runs(part):
            own = part[a[0] : a[1]]
            out.append(mix(np.array([(_long_word(own) + len(own) * int(_LENGTH)) % 2**64], np.uint64)))
    hashes = np.concatenate(out)
    return hashes, np.array([0, len(hashes)])


def _runs(data: np.ndarray) -> list[tuple[int, int]]:
    """Where the words of a part with a very long one begin and end, found block by block."""
    edges, before = [], False
    for a in range(0, len(data), 1 << 22):
        inside = ~SPACE[data[a : a + (1 << 22)]]
        change = np.flatnonzero(inside != np.concatenate(([before], inside[:-1]))) + a
        edges += change.tolist()
        before = bool(inside[-1])
    return list(zip(edges[::2], [*edges[1::2], len(data)] if len(edges) % 2 else edges[1::2]))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row its distinct ``k``-word shingles as sorted 64-bit hashes; fewer words: the whole sequence as one."""
    n = len(hashes)
    if n >= k:
        runs = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            runs = runs * _STEP + hashes[j : n - k + 1 + j]
        runs = mix(runs + _U(k * int(_LENGTH) % 2**64))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for j in range(a, b):
                h = h * _STEP + hashes[j]
            out.append(mix(h + _U((b - a) * int(_LENGTH) % 2**64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
