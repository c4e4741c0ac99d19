"""Counting quotient filters over packed n-grams: sorted tables of keys and counts in few bytes, without loss.

A key is a pair of halves of ``half`` bits each. A keyed permutation (Feistel rounds) spreads keys evenly and can be undone. Of the
permuted key the leading bits name a range, the next ones are the *quotient*, and all of the rest is stored as *remainder*; so keys come
back whole. A filter holds one bit per quotient (is it in use), one bit per entry (is it the last of its quotient), the
remainders in as many bytes as they need, and the counts in one byte each, with an own list for large ones.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from tallygrid.llm.textkit import mix

ROUND_KEYS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
LARGE = 255


def _turn(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    return mix(half + np.uint64(key)) >> np.uint64(64 - bits)


def permute(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    for key in ROUND_KEYS:
        high, low = low, high ^ _turn(low, key, bits)
    return high, low


def restore(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    for key in reversed(ROUND_KEYS):
        high, low = low ^ _turn(high, key, bits), high
    return high, low


@dataclass
class Tally:
    """Distinct keys in order, with their counts."""

    high: np.ndarray
    low: np.ndarray
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.counts)

    def slice(self, a: int, b: int) -> Tally:
        return Tally(self.high[a:b], self.low[a:b], self.counts[a:b])


def tally(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None, bits: int) -> Tally:
    """Sort keys and add up the counts of equal ones; without counts each stands for one."""
    if not len(high):
        return Tally(high, low, np.zeros(0, np.int64))
    if 2 * bits <= 64:
        key = high << np.uint64(bits) | low if bits < 64 else low
        if counts is None:
            key = np.sort(key)
        else:
            order = np.argsort(key)
            key, counts = key[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        high, low = key[new] >> np.uint64(bits), key[new] & np.uint64((1 << bits) - 1)
    else:
        # The leading 64 bits are sorted; the rest hardly ever decides, since keys are permuted.
        room, extra = np.uint64(64 - bits), np.uint64(2 * bits - 64)
        mask = (np.uint64(1) << extra) - np.uint64(1)
        rest = (low & mask).astype(np.min_scalar_type(int(mask)))
        key = high << room
        key |= low >> extra
        del high, low
        order = np.argsort(key)
        key, rest = key[order], rest[order]
        same = key[1:] == key[:-1]
        if (same & (rest[1:] != rest[:-1])).any():
            again = np.lexsort((rest, key))
            key, rest, order = key[again], rest[again], order[again]
            same = key[1:] == key[:-1]
        counts = None if counts is None else counts[order]
        new = np.flatnonzero(np.concatenate([[True], ~same | (rest[1:] != rest[:-1])]))
        lead = key[new]
        high, low = lead >> room, (lead & ((np.uint64(1) << room) - np.uint64(1))) << extra | rest[new].astype(np.uint64)
    sums = np.diff(np.append(new, len(key))) if counts is None else np.add.reduceat(counts, new)
    return Tally(high, low, sums.astype(np.int64))


def merged(parts: list[Tally], bits: int) -> Tally:
    """The parts as one; the list is emptied, so that they need no memory while they are sorted."""
    columns = [np.concatenate([getattr(p, c) for p in parts]) for c in ("counts", "low", "high")]
    parts.clear()
    return tally(columns.pop(), columns.pop(), columns.pop(), bits)


def _bytes_of(values: np.ndarray, bits: int) -> bytes:
    width = -(-bits // 8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _from_bytes(data: memoryview, size: int, bits: int) -> tuple[np.ndarray, int]:
    width = -(-bits // 8)
    wide = np.zeros((size, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data[: size * width], np.uint8).reshape(size, width)
    return wide.view("<u8").ravel(), size * width


def encode(part: Tally, bits: int, range_bits: int) -> bytes:
    """The filter of entries that agree in the ``range_bits`` leading bits of the upper half."""
    size = len(part)
    q = min(bits - range_bits, max(1, size - 1).bit_length())
    rest = bits - range_bits - q
    upper = part.high & np.uint64((1 << (bits - range_bits)) - 1)
    quotient = (upper >> np.uint64(rest)).astype(np.int64)
    used = np.zeros(1 << q, bool)
    used[quotient] = True
    last = np.append(quotient[1:] != quotient[:-1], True)
    large = part.counts >= LARGE
    head = struct.pack("<IBI", size, q, int(large.sum()))
    small = np.where(large, LARGE, part.counts).astype(np.uint8)
    return b"".join([
        head, np.packbits(used).tobytes(), np.packbits(last).tobytes(), _bytes_of(upper & np.uint64((1 << rest) - 1), rest), _bytes_of(part.low, bits),
        small.tobytes(), part.counts[large].astype("<i8").tobytes(),
    ])


def decode(blob: bytes, bits: int, range_bits: int, at: int) -> Tally:
    """The entries of a filter of range ``at``."""
    size, q, n_large = struct.unpack_from("<IBI", blob)
    rest = bits - range_bits - q
    data = memoryview(blob)[struct.calcsize("<IBI") :]
    used = np.flatnonzero(np.unpackbits(np.frombuffer(data[: -(-(1 << q) // 8)], np.uint8), count=1 << q))
    data = data[-(-(1 << q) // 8) :]
    last = np.unpackbits(np.frombuffer(data[: -(-size // 8)], np.uint8), count=size).astype(np.int64)
    data = data[-(-size // 8) :]
    remainder, step = _from_bytes(data, size, rest)
    data = data[step:]
    low, step = _from_bytes(data, size, bits)
    data = data[step:]
    counts = np.frombuffer(data[:size], np.uint8).astype(np.int64)
    counts[counts == LARGE] = np.frombuffer(data[size : size + 8 * n_large], "<i8")
    quotient = used[np.cumsum(last) - last].astype(np.uint64)
    lead = np.uint64(at << (bits - range_bits)) if range_bits else np.uint64(0)
    return Tally(lead | quotient << np.uint64(rest) | remainder, low, counts)


def ranges(part: Tally, bits: int, range_bits: int) -> list[tuple[int, Tally]]:
    """The entries by the leading bits of their keys."""
    own = (part.high >> np.uint64(bits - range_bits)).astype(np.int64)
    edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
    return [(int(own[a]), part.slice(a, b)) for a, b in zip(edges, edges[1:]) if b > a]
