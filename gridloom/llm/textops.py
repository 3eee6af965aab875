"""Words and hashed word windows of one text, in numpy; used inside Arrow functions."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX_A = np.uint64(0x9E3779B97F4A7C15)
_MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)


def words(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space and tab to carriage return, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each k consecutive words."""
    n = hashes.size - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = hashes[:n] ^ np.uint64(k)
    for j in range(1, k):
        acc ^= acc >> _S32
        acc *= _MIX_A
        acc += hashes[j : j + n]
    acc ^= acc >> _S29
    acc *= _MIX_B
    acc ^= acc >> _S32
    return acc


def shingle_set(tokens: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter sequence is one shingle, none is empty."""
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = word_hashes(tokens)
    return np.unique(window_hashes(hashes, min(k, hashes.size)))
