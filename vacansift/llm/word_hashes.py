"""Words of texts as 64-bit hashes, computed for whole batches in numpy."""

from __future__ import annotations

import numpy as np

# Each byte value has a random number per place in its word (modulo 64); a word's hash is their sum, mixed with its length.
_MIX = np.random.default_rng(64).integers(0, 1 << 64, (64, 256), dtype=np.uint64, endpoint=False)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def combined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of pairs that depends on their order."""
    return mixed(left * _GOLDEN + mixed(right ^ _GOLDEN))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word (a run of bytes that are no white space) of all texts, and word offsets of the texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:-1]
    start = np.flatnonzero(begins)
    place = np.flatnonzero(solid)
    signs = data[place]
    if lower:
        signs = _ASCII_LOWER[signs]
    at = np.searchsorted(place, start)
    length = np.diff(np.concatenate([at, [len(place)]]))
    within = np.arange(len(place)) - np.repeat(at, length)
    # Words over 64 bytes reuse places, so the block number goes into the sum as a factor.
    parts = _MIX[within & 63, signs]
    far = np.flatnonzero(within >= 64)
    parts[far] = mixed(parts[far] + (within[far] >> 6).astype(np.uint64) * _GOLDEN)
    sums = np.add.reduceat(parts, at) if len(at) else np.zeros(0, np.uint64)
    hashes = mixed(sums + length.astype(np.uint64) * _GOLDEN)
    return hashes, start, start + length, np.searchsorted(start, offsets)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words (runs across texts are for the caller to leave out)."""
    if len(hashes) < size:
        return hashes[:0]
    out = hashes[: len(hashes) - size + 1].copy()
    for k in range(1, size):
        out = combined(out, hashes[k : len(hashes) - size + 1 + k])
    return out
