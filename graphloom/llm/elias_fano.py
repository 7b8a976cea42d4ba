"""Elias-Fano coding of monotone integers, with vectorised successor search, and a two-level n-gram trie on it."""

from __future__ import annotations

import os
import tempfile

import numpy as np

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Position of the k-th zero (0-based) of a byte, 8 where there is none.
_ZERO_AT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if not _b >> p & 1):
        _ZERO_AT[_b, _k] = _p


class EliasFano:
    """A sorted array of integers under 2**62, as low bits and a unary bitmap of high parts.

    About 2 + log2(universe / n) bits an entry; `get` reads entries, `successor` finds the first entry that isn't less."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.int64)
        self.n = n = len(values)
        top = int(values[-1]) + 1 if n else 1
        self.low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        width = max(1, -(-self.low_bits // 8))
        low = values & ((1 << self.low_bits) - 1)
        self.low = np.stack([(low >> (8 * i)) & 255 for i in range(width)], 1).astype(np.uint8) if n else np.zeros((0, width), np.uint8)
        high = values >> self.low_bits
        bits = np.zeros((int(high[-1]) if n else 0) + n + 2, np.uint8)
        bits[high + np.arange(n)] = 1
        self.high = np.packbits(bits, bitorder="little")
        self._directory()

    def _directory(self) -> None:
        zeros = 8 - _ONES[self.high].astype(np.int64)
        self.zeros = np.concatenate([[0], np.cumsum(zeros)])
        self.ones = np.concatenate([[0], np.cumsum(_ONES[self.high].astype(np.int64))])

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Bit position of the k-th zero; the end where there is none."""
        byte = np.minimum(np.searchsorted(self.zeros, k, side="right") - 1, len(self.high) - 1)
        inner = np.minimum(k - self.zeros[byte], 7)
        return byte * 8 + _ZERO_AT[self.high[byte], inner]

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries whose high part is `high`: from first to last (exclusive)."""
        high = np.minimum(high, self.zeros[-1])
        last = self._zero(np.minimum(high, self.zeros[-1] - 1)) - high
        before = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - (high - 1), 0)
        return np.minimum(before, self.n), np.minimum(np.maximum(last, before), self.n)

    def lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for i in range(self.low.shape[1]):
            out |= self.low[at, i].astype(np.int64) << (8 * i)
        return out

    def successor(self, values: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place, found): the first entry >= value, and whether it equals it. first, last: the places to search in."""
        if not self.n:
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        high, low = values >> self.low_bits, values & ((1 << self.low_bits) - 1)
        at, end = self.bucket(high)
        at, end = np.maximum(at, first), end if last is None else np.minimum(end, last)
        last = end.copy()
        open_ = np.flatnonzero(at < last)
        while len(open_):  # a context with many words fills few buckets, so each is halved, not walked
            middle = (at[open_] + last[open_]) >> 1
            less = self.lows(middle) < low[open_]
            at[open_[less]] = middle[less] + 1
            last[open_[~less]] = middle[~less]
            open_ = open_[at[open_] < last[open_]]
        inside = np.flatnonzero(at < end)
        found = np.zeros(len(values), bool)
        found[inside] = self.lows(at[inside]) == low[inside]
        return at, found

    def get(self, at: np.ndarray) -> np.ndarray:
        """The entries at these places."""
        byte = np.minimum(np.searchsorted(self.ones, at, side="right") - 1, len(self.high) - 1)
        bits = np.unpackbits(self.high[byte][:, None], axis=1, bitorder="little").astype(np.int64)
        place = (np.cumsum(bits, 1) == (at - self.ones[byte] + 1)[:, None]) & (bits == 1)
        position = byte * 8 + place.argmax(1)
        return ((position - at) << self.low_bits) | self.lows(at)

    def parts(self) -> list[str]:
        return ["low", "high"]


def mapped(arrays: list[tuple[object, str]]) -> None:
    """Move these arrays (object, attribute) to one memory-mapped file, which goes when the arrays do.

    The file is a task's scratch in its own temporary folder: no other task reads it, and a lost one builds it anew."""
    handle, path = tempfile.mkstemp(suffix=".trie")
    os.close(handle)
    try:
        with open(path, "wb") as f:
            for owner, name in arrays:
                f.write(np.ascontiguousarray(getattr(owner, name)).tobytes())
        size = os.path.getsize(path)
        if size:
            data, at = np.memmap(path, np.uint8, "r"), 0
            for owner, name in arrays:
                old = getattr(owner, name)
                new = data[at : at + old.nbytes].view(old.dtype).reshape(old.shape)
                at += old.nbytes
                setattr(owner, name, new)
    finally:
        os.unlink(path)  # the mapping stays until it is dropped


class Trie:
    """Contexts, and for each the words that follow with a 16-bit code of log10 of their smoothed probability.

    Level 1: context ids, Elias-Fano. Pointers: where each context's words begin in level 2, Elias-Fano. Level 2: the
    words of all contexts, each context's above the last value of the one before (so the whole is monotone),
    Elias-Fano. A word is found by successor search for its value above its context's base, between the context's two
    pointers. Codes: 0 to 65535 over `FLOOR`..0."""

    FLOOR = -16.0

    def __init__(self, contexts: np.ndarray, words: np.ndarray, log10: np.ndarray):
        """Parallel arrays, sorted by context and word, without repetition."""
        kinds, first = np.unique(contexts, return_index=True)
        sizes = np.diff(np.append(first, len(words)))
        tops = words[np.append(first[1:], len(words)) - 1].astype(np.int64) + 1 if len(words) else np.zeros(0, np.int64)
        bases = np.concatenate([[0], np.cumsum(tops)])[:-1] if len(tops) else np.zeros(0, np.int64)
        self.level1, self.pointers = EliasFano(kinds), EliasFano(np.append(first, len(words)))
        self.level2 = EliasFano(np.repeat(bases, sizes) + words)
        self.codes = np.rint(np.clip(log10 / self.FLOOR, 0, 1) * 65535).astype(np.uint16)
        mapped([(e, p) for e in (self.level1, self.pointers, self.level2) for p in e.parts()] + [(self, "codes")])

    def _range(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of contexts by place: first and last pointer, and the base of their words' values."""
        begin, end = self.pointers.get(place), self.pointers.get(place + 1)
        before = self.level2.get(np.maximum(begin - 1, 0)) + 1
        return begin, end, np.where(begin > 0, before, 0)

    def log10(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log10 probability of each word in its context; NaN where the context doesn't have the word."""
        out = np.full(len(contexts), np.nan)
        kinds, at = np.unique(contexts, return_inverse=True)
        place, known = self.level1.successor(kinds)
        own = np.flatnonzero(known)
        begin, end, base = (np.zeros(len(kinds), np.int64) for _ in range(3))
        if len(own):
            begin[own], end[own], base[own] = self._range(place[own])
        ask = np.flatnonzero(known[at])
        if len(ask):
            k = at[ask]
            where, found = self.level2.successor(base[k] + words[ask], begin[k], end[k])
            out[ask[found]] = self.codes[where[found]] * (self.FLOOR / 65535)
        return out

    def followers(self, context: int) -> np.ndarray:
        """Word ids that follow a context."""
        place, known = self.level1.successor(np.array([context]))
        if not known[0]:
            return np.zeros(0, np.int64)
        begin, end, base = self._range(place[:1])
        return self.level2.get(np.arange(begin[0], end[0])) - base[0]
