"""Elias-Fano sequences and a trie level made of them, in memory-mapped arrays, searched for many values at once."""

from __future__ import annotations

import tempfile

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_POPCOUNT = _BITS.sum(1).astype(np.int64)
#: Place of the r-th one of a byte.
_SELECT = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _SELECT[_byte, : _POPCOUNT[_byte]] = np.flatnonzero(_BITS[_byte])


def mapped(array: np.ndarray) -> np.ndarray:
    """The array in a memory-mapped file without a name, which goes when the last reader does."""
    if not array.size:
        return array
    with tempfile.TemporaryFile() as file:
        array.tofile(file)
        file.flush()
        return np.memmap(file, array.dtype, "r", shape=array.shape)


def _lookup(sequence: np.ndarray, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """First place in [begin, end) of the sequence, ascending there, that is not below the wanted value; all ranges at once."""
    low, high = begin.copy(), end.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        below = sequence[middle] < wanted[live]
        low[live[below]] = middle[below] + 1
        high[live[~below]] = middle[~below]
        live = live[low[live] < high[live]]
    return low


class EliasFano:
    """An ascending sequence of whole numbers: low bits as they are, high bits in unary."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        mask = np.uint64((1 << self.low_bits) - 1)
        kind = np.uint8 if self.low_bits <= 8 else np.uint16 if self.low_bits <= 16 else np.uint32 if self.low_bits <= 32 else np.uint64
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.last = top >> self.low_bits
        bits = np.zeros(-(-(n + self.last + 2) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_POPCOUNT[packed].reshape(-1, 8).sum(1))])
        self.low, self.bytes = mapped((values & mask).astype(kind)), mapped(packed.reshape(-1, 8))
        self.ones = mapped(ones)
        self.zeros = mapped(64 * np.arange(len(ones)) - ones)

    def _select(self, counts: np.ndarray, ranks: np.ndarray, flip: int) -> np.ndarray:
        """Places of the bits with these ranks."""
        word = np.searchsorted(counts, ranks, "right") - 1
        rest = ranks - counts[word]
        octets = self.bytes[word] ^ np.uint8(flip)
        sums = np.cumsum(_POPCOUNT[octets], 1)
        byte = (sums <= rest[:, None]).sum(1)
        rows = np.arange(len(ranks))
        before = np.where(byte > 0, sums[rows, byte - 1], 0)
        return 64 * word + 8 * byte + _SELECT[octets[rows, byte], rest - before]

    def get(self, at: np.ndarray) -> np.ndarray:
        high = self._select(self.ones, at, 0) - at
        return (high << self.low_bits) | self.low[at].astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted value, or -1."""
        if not self.n:
            return np.full(len(wanted), -1)
        wanted = wanted.astype(np.uint64)
        high = (wanted >> np.uint64(self.low_bits)).astype(np.int64)
        low = wanted & np.uint64((1 << self.low_bits) - 1)
        inside = np.flatnonzero(high <= self.last)
        h = high[inside]
        begin = np.zeros(len(h), np.int64)
        later = h > 0
        begin[later] = self._select(self.zeros, h[later] - 1, 255) - (h[later] - 1)
        end = self._select(self.zeros, h, 255) - h
        at = _lookup(self.low, begin, end, low[inside])
        hit = at < end
        hit[hit] = self.low[at[hit]] == low[inside][hit]
        out = np.full(len(wanted), -1)
        out[inside[hit]] = at[hit]
        return out


class Level:
    """A level of a trie: contexts, pointers to their successors, and a code for each successor.

    Keys are 64-bit: context in the high half, successor in the low half. ``keys`` ascend and differ.
    """

    def __init__(self, keys: np.ndarray, codes: np.ndarray):
        context = (keys >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = EliasFano(context[first])
        self.pointers = EliasFano(np.concatenate([first, [len(keys)]]))
        self.successors = mapped((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        self.codes = mapped(codes)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """The codes of the keys, 0 for what the level does not hold."""
        out = np.zeros(len(keys), self.codes.dtype)
        context = self.contexts.find(keys >> np.uint64(32))
        known = np.flatnonzero(context >= 0)
        if not len(known):
            return out
        begin, end = self.pointers.get(context[known]), self.pointers.get(context[known] + 1)
        wanted = (keys[known] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = _lookup(self.successors, begin, end, wanted)
        hit = at < end
        hit[hit] = self.successors[at[hit]] == wanted[hit]
        out[known[hit]] = self.codes[at[hit]]
        return out
