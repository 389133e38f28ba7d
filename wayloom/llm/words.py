"""Words and their 64-bit ids inside tasks.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, which is what ``bytes.split`` separates.
"""

from __future__ import annotations

import numpy as np
import xxhash

# Mixing constants of the SplitMix64 generator (fixed values).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


class WordIds(dict):
    """Word to 64-bit id; remembers up to ``limit`` words, the ids do not depend on that."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose output bits look independent."""
    values = (values + GOLDEN).astype(np.uint64)
    values = (values ^ (values >> np.uint64(30))) * MIX_1
    values = (values ^ (values >> np.uint64(27))) * MIX_2
    return values ^ (values >> np.uint64(31))


def windows(ids: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all runs of ``length`` ids; empty if there are fewer."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    found, span = ids, 1
    # Doubling: the hash of a run is made of the hashes of its two halves.
    parts = {1: ids}
    while span * 2 <= length:
        found = mix(found[: len(found) - span] * GOLDEN + found[span:])
        span *= 2
        parts[span] = found
    at, whole = 0, None
    for span in sorted(parts, reverse=True):
        if length - at >= span:
            piece = parts[span][at : at + n]
            whole = piece if whole is None else mix(whole * GOLDEN + piece)
            at += span
    return whole


def utf8(column) -> list[bytes]:
    """An Arrow column of binary texts as bytes, null as empty."""
    return [x or b"" for x in column.to_pylist()]
