"""Sets of word shingles as 64-bit hashes, and their compressed MinHash registers."""

from __future__ import annotations

import numpy as np

from ledgerlens.llm.common import text_words

SHINGLE = 5
REGISTERS = 192
"""Buckets of a sketch; each holds the minimum under a permutation of its own."""
MANTISSA = 10
"""Mantissa bits a register keeps beside its count of leading zeros."""
FINE = 1024
"""Minima of a fine sketch."""

CACHE_WORDS = 500_000
_rng = np.random.default_rng(20_240_501)
_POSITION = _rng.integers(1, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 32, REGISTERS, np.uint64).astype(np.uint32)
_FACTOR = _rng.integers(0, 1 << 31, REGISTERS, np.uint64).astype(np.uint32) * np.uint32(
    2
) + np.uint32(1)
_FINE_FLIP = _rng.integers(0, 1 << 32, FINE, np.uint64).astype(np.uint32)
_FINE_FACTOR = _rng.integers(0, 1 << 31, FINE, np.uint64).astype(np.uint32) * np.uint32(
    2
) + np.uint32(1)


class _WordHashes(dict):
    """64-bit hashes of words, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text; of all its words if fewer."""
    words = text_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(w) < SHINGLE:
        total = (w * _POSITION[: len(w)]).sum() + np.uint64(len(w))
        return _mixed(np.array([total], np.uint64))
    n = len(w) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += w[i : i + n] * _POSITION[i]
    return np.unique(_mixed(total))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the minimum in every bucket, 16 bits each."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    folded = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(folded), 256):
        part = (folded[at : at + 256, None] ^ _FLIP) * _FACTOR
        np.minimum(low, part.min(axis=0), out=low)
    fraction, exponent = np.frexp(np.maximum(low, 1).astype(np.float64))
    mantissa = ((fraction - 0.5) * (2 << MANTISSA)).astype(np.uint16)
    return ((32 - exponent).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa


def fine_sketch(hashes: np.ndarray) -> np.ndarray:
    """One byte of each of FINE minima: a second, longer sketch for doubtful pairs."""
    low = np.full(FINE, 0xFFFFFFFF, np.uint32)
    folded = hashes.astype(np.uint32)
    for at in range(0, len(folded), 64):
        part = (folded[at : at + 64, None] ^ _FINE_FLIP) * _FINE_FACTOR
        np.minimum(low, part.min(axis=0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def fine_estimate(same: np.ndarray) -> np.ndarray:
    """Jaccard estimate from equal bytes of fine sketches; bytes agree by chance once in 256."""
    return (same / FINE - 1 / 256) / (1 - 1 / 256)


def jaccard_estimate(same: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from equal registers of sets of sizes n and m.

    Registers of unrelated minima agree by chance. A register cell at x is about
    0.72 x / 2^MANTISSA wide, and minima are about exponential with rates n and m, so the
    expected share of such collisions is 0.72 n m / (n + m)^2 / 2^MANTISSA; it is taken out.
    """
    n, m = n.astype(np.float64), m.astype(np.float64)
    chance = REGISTERS * 0.72 * n * m / np.maximum(n + m, 1) ** 2 / (1 << MANTISSA)
    return (same - chance) / (REGISTERS - chance)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection is at least ``percent`` times the union."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
