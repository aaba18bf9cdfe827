"""Signatures of canonical texts: minima of hashed windows, band keys, bit fingerprints, pivot distances, sketches."""

from __future__ import annotations

import numpy as np

from driftsieve.llm.textforms import mix, window_hashes

WIDTH = 20  # characters of a window
ROWS, BANDS = 3, 24  # minima in a band key, band keys of a text
PIVOTS = 64  # reference fingerprints
BITS = 2 * ROWS * BANDS  # of a fingerprint: two of each minimum

_rng = np.random.default_rng(20310101)
_XOR = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)
_MUL = (_rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_PIVOTS = _rng.integers(0, 2, (PIVOTS, BITS), dtype=np.int8)


def inside(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values at windows, without those that run over the end of a text."""
    edge = np.zeros(len(values) + 1, np.int8)
    edge[starts] += 1
    edge[starts + counts] -= 1
    return values[np.cumsum(edge[:-1], dtype=np.int8) > 0]


def minima(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """For each text, the least of each permuted 32-bit hash over its windows."""
    hashes, starts, counts = window_hashes(texts, width)
    out = np.empty((len(texts), ROWS * BANDS), np.uint32)
    if not len(texts):
        return out
    low = inside((hashes >> np.uint64(32)).astype(np.uint32), starts, counts)
    starts = np.cumsum(counts) - counts
    work = np.empty_like(low)
    for k in range(ROWS * BANDS):
        np.bitwise_xor(low, _XOR[k], out=work)
        np.multiply(work, _MUL[k], out=work)
        out[:, k] = np.minimum.reduceat(work, starts)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a text, different between bands."""
    keys = np.repeat((np.arange(BANDS, dtype=np.uint64) + np.uint64(1))[None, :] * np.uint64(0xA24BAED4963EE407), len(mins), 0)
    cube = mins.reshape(len(mins), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        keys = mix((keys ^ cube[:, :, r]) * np.uint64(0x9FB21C651E98DF25))
    return keys.view(np.int64)


def fingerprints(mins: np.ndarray) -> np.ndarray:
    """Bits (0 or 1) of each text: two texts differ in about half of their share of unequal minima."""
    mixed = (mins ^ (mins >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    mixed ^= mixed >> np.uint32(12)
    return np.concatenate([(mixed >> np.uint32(3)) & np.uint32(1), (mixed >> np.uint32(17)) & np.uint32(1)], axis=1).astype(np.int8)


def pivot_distances(bits: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference fingerprint."""
    a, p = bits.astype(np.float32), _PIVOTS.astype(np.float32)
    return (a.sum(1)[:, None] + p.sum(1)[None, :] - 2 * (a @ p.T)).astype(np.uint8)


def sketch(texts: list[str], size: int, width: int = WIDTH) -> tuple[list[np.ndarray], np.ndarray]:
    """The `size` least window hashes of each text, ascending, and its number of distinct windows in all."""
    hashes, starts, counts = window_hashes(texts, width)
    out = []
    for s, n in zip(starts.tolist(), counts.tolist()):
        out.append(hashes[s : s + n])
    return out, counts
