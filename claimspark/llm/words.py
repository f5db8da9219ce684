"""Words of UTF-8 bytes as 64-bit hashes, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(PRIME), -1, 1 << 64))
#: Bytes hashed at once; a piece ends before white space, so a longer word makes a longer piece.
PIECE = 1 << 18
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=4)
def _grown(of: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, of, np.uint64)]))


def powers(of: np.uint64, n: int) -> np.ndarray:
    """of**0 to of**n at least."""
    return _grown(int(of), 1 << max(12, int(n).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * PRIME
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words between ASCII white space in bytes."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not (found := np.flatnonzero(BLANK[data[end : end + PIECE]])[:1]).size:
            end = min(len(data), end + PIECE)
        end += int(found[0]) if end < len(data) else 0
        b = data[at:end]
        edges = np.flatnonzero(np.diff(BLANK[b], prepend=True, append=True))
        first, last = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(PRIME, len(b))[: len(b)], dtype=np.uint64)])
        hashes.append(mixed((sums[last] - sums[first]) * powers(INVERSE, len(b))[first] + (last - first).astype(np.uint64)))
        starts.append(first + at)
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z."""
    return data + ((data >= 65) & (data <= 90)) * np.uint8(32)
