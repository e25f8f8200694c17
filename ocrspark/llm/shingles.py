"""Sets of hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from ocrspark.llm.common import U64, mix, word_codes

STEP = U64(0x9E3779B97F4A7C15)


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), U64, len(words))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words of a sequence; a shorter sequence is one window."""
    size = len(hashes)
    if not size:
        return hashes
    width = min(n, size)
    out = np.full(size - width + 1, width, U64)
    for k in range(width):
        out = mix(out * STEP + hashes[k : size - width + 1 + k])
    return out


def sets(text: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct window hashes of every text; none for a text without words."""
    ends, codes, words = word_codes(text)
    hashes = word_hashes(words)[codes] if len(codes) else np.zeros(0, U64)
    ends = ends.tolist()
    # windows over all texts at once, then those that cross from one text to the next are left out
    if len(hashes) >= n:
        every = windows(hashes, n)
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        out.append(np.unique(every[a : b - n + 1] if b - a >= n else windows(hashes[a:b], n)))
    return out
