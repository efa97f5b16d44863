"""Words of a text and sets of hashed word shingles, with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Lower-cases A-Z in UTF-8 bytes; bytes.split() then splits at [\x20\x09-\x0D] alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Odd constants that tell the places of words in a shingle apart.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all shingles of ``width`` words; a shorter text is one shingle."""
    h = word_hashes(word_list(text))
    if not len(h):
        return h
    take = min(width, len(h))
    m = len(h) - take + 1
    s = np.full(m, np.uint64(take))
    for j in range(take):
        s = s * np.uint64(0x9E3779B97F4A7C15) + mix(h[j : j + m] * ODD[j % len(ODD)])
    return np.unique(mix(s))
