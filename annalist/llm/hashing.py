"""64-bit hashes of many words at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_random = np.random.default_rng(7)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
STEP = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


# Words hashed at once, so that the arrays of their bytes stay in a core's cache.
CHUNK = 8192


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A polynomial over the bytes of each word, then spread."""
    out = np.empty(len(words), np.uint64)
    for at in range(0, len(words), CHUNK):
        part = words[at : at + CHUNK]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        data = np.frombuffer(b"".join(part), np.uint8)
        starts = np.cumsum(sizes) - sizes
        within = np.arange(len(data)) - np.repeat(starts, sizes)
        powers = np.cumprod(np.full(int(sizes.max()), STEP))
        total = np.add.reduceat(_BYTE[data] * powers[within], starts)
        out[at : at + CHUNK] = mix(total + sizes.astype(np.uint64))
    return out


def gram_hashes(hashes: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hashes of each run of ``size`` words: a sum with its own odd factor for each place."""
    count = max(len(hashes) - size + 1, 0)
    factors = np.random.default_rng(salt).integers(1, 1 << 63, size, dtype=np.uint64) * U(2) + U(1)
    total = np.zeros(count, np.uint64)
    for place, factor in enumerate(factors):
        total += hashes[place : place + count] * factor
    return mix(total)
