"""Words of texts as arrays of 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

#: Maximal runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Distinct words remembered by a task before its memory is emptied.
MEMORY = 500_000


class WordHashes(dict):
    """word -> signed 64-bit hash, the same in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = WORD.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose lengths add up to `most` or little more, so that memory stays bounded."""
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)
