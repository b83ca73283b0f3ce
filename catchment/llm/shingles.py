"""Hashed word shingles and their minwise sketches."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
COORDINATES = 128
WORD_CACHE = 200_000
BLOCK = 1 << 17

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_known: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text.

    A-Z is lowered and words are runs of anything but blank and the controls 9 to 13, which is
    how bytes are lowered and split. Fewer than five words are one shingle; no words, none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_known) > WORD_CACHE:
        _known.clear()
    for w in words:
        if w not in _known:
            _known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(words) < WORDS:
        total = np.array([len(words)], dtype=np.uint64)
        for x in h:
            total = mixed(total * _GOLDEN + x)
        return total
    total = h[:len(h) - WORDS + 1].copy()
    for i in range(1, WORDS):
        total = total * _GOLDEN + h[i:len(h) - WORDS + 1 + i]
    return np.unique(mixed(total))


def forget() -> None:
    """Drop the words that a worker keeps."""
    _known.clear()


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The minimum of each of the coordinates' hash functions over each set, (sets x 128)."""
    out = np.full((len(sets), COORDINATES), 0xFFFFFFFF, dtype=np.uint32)
    start = 0
    while start < len(sets):
        end, total = start, 0
        while end < len(sets) and (end == start or total + len(sets[end]) <= BLOCK):
            total += len(sets[end])
            end += 1
        filled = [i for i in range(start, end) if len(sets[i])]
        if filled:
            flat = np.concatenate([sets[i] for i in filled])
            offsets = np.cumsum([0, *[len(sets[i]) for i in filled[:-1]]])
            for c, factor in enumerate(_FACTORS):
                out[filled, c] = np.minimum.reduceat(flat * factor, offsets) >> np.uint64(32)
        start = end
    return out
