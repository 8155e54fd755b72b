"""Words of a byte buffer as arrays: keys, and a table that remembers a sequence per word.

Everything here works on whole batches with NumPy, so a word costs some ten nanoseconds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_PRIME = np.uint64(0x9E3779B185EBCA87)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
MAX_WORD = 64  # bytes; longer words are not remembered


def word_keys(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key per word: exact bytes are mixed eight at a time, the length goes in first.

    Words of eight bytes or fewer of one length never share a key (each step is invertible).
    """
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(buf) + 1,), strides=(1,))
    size = end - start
    key = size.astype(np.uint64) * _MIX
    live = np.arange(len(start))
    at, left = start, size
    while len(live):
        lane = lanes[at]
        short = left < 8
        keep = np.where(short, left, 8).astype(np.uint64)
        mask = np.where(short, (np.uint64(1) << (keep * np.uint64(8) % np.uint64(64))) - np.uint64(1), ~np.uint64(0))
        k = (key[live] ^ (lane & mask)) * _PRIME
        key[live] = k ^ (k >> np.uint64(29))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return key


def gather(offset: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Concatenate the slices flat[offset : offset + size]."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return flat[np.repeat(offset - before, size) + np.arange(total)]


class WordTable:
    """Word key to a sequence of numbers, in an open-addressed array; emptied when full.

    ``encode(words)`` gives, for a list of byte strings, the sizes and the concatenated values.
    It is called once per distinct word of a batch that the table does not hold, so the table
    changes the time taken and never the values.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype=np.int32, bits: int = 21):
        self.encode, self.dtype, self.bits = encode, dtype, bits
        self._clear()

    def _clear(self) -> None:
        n = 1 << self.bits
        self.keys = np.zeros(n, np.uint64)
        self.index = np.full(n, -1, np.int32)
        self.offset = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, self.dtype)
        self.count = self.used = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _PRIME) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        slot, live, wrap = self._slot(keys), np.arange(len(keys)), (1 << self.bits) - 1
        while len(live):
            held = self.index[slot]
            hit = (held >= 0) & (self.keys[slot] == keys[live])
            found[live[hit]] = held[hit]
            go = (held >= 0) & ~hit
            live, slot = live[go], (slot[go] + 1) & wrap
        return found

    def _add(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        n, m = len(keys), len(flat)
        while self.count + n > len(self.offset):
            self.offset, self.size = np.resize(self.offset, 2 * len(self.offset)), np.resize(self.size, 2 * len(self.size))
        while self.used + m > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        new = np.arange(self.count, self.count + n)
        self.offset[new], self.size[new] = self.used + np.cumsum(size) - size, size
        self.flat[self.used : self.used + m] = flat
        self.count, self.used = self.count + n, self.used + m
        slot, live, wrap = self._slot(keys), np.arange(n), (1 << self.bits) - 1
        while len(live):
            free = self.index[slot] < 0
            self.index[slot[free]] = new[live[free]]
            mine = self.index[slot] == new[live]
            self.keys[slot[mine]] = keys[live[mine]]
            live, slot = live[~mine], (slot[~mine] + 1) & wrap

    def values(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes per word and the values of all words in order."""
        size = np.zeros(len(start), np.int64)
        long = end - start > MAX_WORD
        if long.any():
            return self._with_long(buf, start, end, long)
        keys = word_keys(buf, start, end)
        found = self._find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            fresh, first = np.unique(keys[missing], return_index=True)
            if self.count + len(fresh) > (1 << self.bits) // 2:
                self._clear()
                found[:] = -1
                fresh, first = np.unique(keys, return_index=True)
                missing = np.arange(len(keys))
            if len(fresh) > (1 << self.bits) // 2:
                half = len(start) // 2
                a, b = self.values(buf, start[:half], end[:half]), self.values(buf, start[half:], end[half:])
                return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
            data = buf.tobytes()
            at = missing[first]
            sizes, flat = self.encode([data[s:e] for s, e in zip(start[at].tolist(), end[at].tolist())])
            self._add(fresh, sizes, flat)
            found[missing] = self._find(keys[missing])
        size = self.size[found]
        return size, gather(self.offset[found], size, self.flat)

    def _with_long(self, buf, start, end, long):
        data = buf.tobytes()
        at = np.flatnonzero(long)
        long_size, long_flat = self.encode([data[s:e] for s, e in zip(start[at].tolist(), end[at].tolist())])
        size = np.zeros(len(start), np.int64)
        size[long] = long_size
        short_size, short_flat = self.values(buf, start[~long], end[~long])
        size[~long] = short_size
        from_long = np.repeat(long, size)
        flat = np.empty(int(size.sum()), self.dtype)
        flat[from_long], flat[~from_long] = long_flat, short_flat
        return size, flat
