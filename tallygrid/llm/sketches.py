"""Word shingles and their fast similarity sketches.

A sketch has ``size`` coordinates. Round i below ``size`` puts every element of a set into one bin by a hash; round i from ``size``
on puts all into bin i - size. A bin keeps the smallest hash of the first round that reached it, and rounds stop when every bin is
filled, which the last ``size`` rounds guarantee. Two sets agree in a coordinate with a probability of their Jaccard similarity, and the
share of equal coordinates is as concentrated as with independent draws, at a cost of set size + size log size.
"""

from __future__ import annotations

import numpy as np

from tallygrid.llm.textkit import WordHashes, mix, starts_of

MULTIPLIER = 0x9E3779B97F4A7C15


def shingle_sets(texts: list[bytes], width: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``width``-word shingles; fewer words make one shingle, none make none."""
    lists = [t.lower().split() for t in texts]
    flat = hashes.of([w for words in lists for w in words])
    begin = starts_of(np.array([len(words) for words in lists]))
    rolled = np.zeros(max(0, len(flat) - width + 1), np.uint64)
    for i in range(width):
        rolled *= np.uint64(MULTIPLIER)
        rolled += flat[i : i + len(rolled)]
    rolled = mix(rolled)
    sets = []
    for k, words in enumerate(lists):
        if len(words) >= width:
            sets.append(np.unique(rolled[begin[k] : begin[k + 1] - width + 1]))
        elif words:
            short = np.array([len(words)], np.uint64)
            for h in flat[begin[k] : begin[k + 1]]:
                short = mix(short * np.uint64(MULTIPLIER) + h)
            sets.append(short)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def sketch(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` coordinates for each set (a power of two); an empty set has a row of the largest value."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * size, empty)
    lengths = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), lengths)
    for i in range(2 * size):
        if not len(elements):
            break
        h = mix(elements + np.uint64((i + 1) * MULTIPLIER & 0xFFFFFFFFFFFFFFFF))
        bins = (h & np.uint64(size - 1)).astype(np.int64) if i < size else i - size
        at = owner * size + bins
        free = out[at] >= np.uint64(i << 52)
        np.minimum.at(out, at[free], (np.uint64(i << 52) | (h[free] >> np.uint64(12))))
        if i < 8 or i % 8 == 0:
            unfilled = (out.reshape(-1, size) == empty).any(1)
            keep = unfilled[owner]
            elements, owner = elements[keep], owner[keep]
    return out.reshape(-1, size)


def bands(size: int, threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows of each): the most rows at which a pair at ``threshold`` is missed with a probability of ``miss`` at most."""
    rows = max((r for r in range(1, size + 1) if (1 - threshold**r) ** (size // r) <= miss), default=1)
    return size // rows, rows


def band_keys(sketches: np.ndarray, count: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    keys = np.tile(np.arange(1, count + 1, dtype=np.uint64), (len(sketches), 1))
    for j in range(rows):
        keys = mix(keys * np.uint64(MULTIPLIER) + sketches[:, j : count * rows : rows])
    return keys
