"""Vectorised words and shingles of UTF-8 texts, as 64-bit hashes.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case. A word's hash is a
polynomial in an odd base modulo 2**64, taken from prefix sums over the bytes, then mixed with its length.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += np.uint64(1)
#: Bytes handled at a time; a part is cut at white space.
_PART = 1 << 20
#: One odd factor for each place of a shingle.
_PLACES = np.array([pow(0xD1342543DE82EF95, 2 * k + 1, 1 << 64) for k in range(64)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


_tables: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept for parts of the usual size."""
    if n > _PART + 4096:
        return _powers(_BASE, n), _powers(_INVERSE, n)
    if not _tables:
        _tables.extend((_powers(_BASE, _PART + 4096), _powers(_INVERSE, _PART + 4096)))
    return _tables[0][:n], _tables[1][:n]


def words(raw: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, first byte and length of every word, in order. outside: which bytes separate words."""
    hashes, starts, lengths = [], [], []
    first, n = 0, len(raw)
    borders = offsets[1:-1]
    while first < n:
        last = min(n, first + _PART)
        while last < n and not outside[raw[last - 1]]:
            step = np.flatnonzero(outside[raw[last : last + _PART]])
            last = last + int(step[0]) + 1 if len(step) else min(n, last + _PART)
        part = raw[first:last]
        gap = np.empty(len(part) + 2, bool)
        gap[0] = gap[-1] = True
        gap[1:-1] = outside[part]
        cut = np.zeros(len(part) + 1, bool)
        cut[borders[(borders >= first) & (borders <= last)] - first] = True
        inside = ~gap[1:-1]
        begin = np.flatnonzero(inside & (gap[:-2] | cut[:-1]))
        end = np.flatnonzero(inside & (gap[2:] | cut[1:])) + 1
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LOWER[part] * up, out=sums[1:])
        hashes.append(mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)))
        starts.append(begin + first)
        lengths.append(end - begin)
        first = last
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(offsets[1:], start, side="right"), start, np.concatenate(lengths)


def shingles(hashes: np.ndarray, text: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and rows + 1 offsets into them.

    A text with fewer words than `size`, but any, has one shingle: all its words."""
    per_text = np.bincount(text, minlength=rows)
    ends = np.cumsum(per_text)
    full = np.maximum(per_text - size + 1, 0)
    short = (per_text > 0) & (per_text < size)
    where = np.ones(len(hashes), bool)
    for k in range(1, size):  # the last size - 1 words of a text begin no shingle
        tail = ends - k
        where[tail[(per_text >= k)]] = False
    at = np.flatnonzero(where)
    total = hashes[at] * _PLACES[0]
    for k in range(1, size):
        total = total + hashes[at + k] * _PLACES[k]
    total = mix(total)
    out, counts = [], np.zeros(rows, np.int64)
    begin = np.concatenate([[0], np.cumsum(full)])
    for r in np.flatnonzero(per_text):
        if short[r]:
            own = hashes[ends[r] - per_text[r] : ends[r]]
            got = mix((own * _PLACES[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))
        else:
            got = np.sort(total[begin[r] : begin[r + 1]])
            got = got[np.concatenate([[True], got[1:] != got[:-1]])]
        out.append(got)
        counts[r] = len(got)
    values = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return values, np.concatenate([[0], np.cumsum(counts)])
