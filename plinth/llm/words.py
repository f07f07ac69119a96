"""Words of whole texts as 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a worker keeps the hash of; beyond it the cache starts anew. It only bounds memory.
CACHED_WORDS = 200_000
#: Odd multipliers for the places of a run, from a fixed seed.
PLACES = np.random.default_rng(20240229).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """The hash of every run of ``length`` words. Longer runs than PLACES are hashed as runs of runs."""
    if len(h) < length:
        return np.empty(0, np.uint64)
    if length > len(PLACES):
        half = length // 2
        left, right = runs(h, half), runs(h, length - half)
        return mix(left[: len(h) - length + 1] * PLACES[0] + right[half:] * PLACES[1] + np.uint64(length))
    total = np.full(len(h) - length + 1, length, np.uint64)
    for i in range(length):
        total += h[i : len(h) - length + 1 + i] * PLACES[i]
    return mix(total)


def fingerprint(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole array, as two signed 64-bit numbers."""
    data = xxhash.xxh3_128_digest(np.ascontiguousarray(h).tobytes())
    return int.from_bytes(data[:8], "big", signed=True), int.from_bytes(data[8:], "big", signed=True)
