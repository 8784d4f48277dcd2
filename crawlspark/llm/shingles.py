"""Word shingles of whole texts as 64-bit hashes, one text at a time, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
REGISTERS = 128
MANTISSA = 10
BAND = 4  # registers in a band

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class WordHashes(dict):
    """Hash of a word, remembered; emptied when it holds ``most`` words, so memory is bounded."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text, A-Z in lower case.

    Words are runs without ASCII white space. Fewer words than five give one value for the whole
    sequence, no words none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    if n < 1:
        return mix((h * _MIX[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
    out = h[:n] * _MIX[0]
    for k in range(1, WORDS):
        out += h[k : n + k] * _MIX[k]
    return np.unique(mix(out))


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    a = shingles.sum(dtype=np.uint64)
    b = mix(shingles ^ _MIX[1]).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def sketch(shingles: np.ndarray) -> bytes:
    """HyperMinHash registers of a set.

    The first seven bits of a hash choose the bucket. A register keeps its smallest remainder as
    leading zeros plus one (six bits) and the ten bits behind the leading one; 0 is an empty bucket.
    """
    out = np.zeros(REGISTERS, ">u2")
    if len(shingles):
        bucket = (shingles >> np.uint64(57)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted: the first of a bucket is its smallest
        rest = (shingles[first] << np.uint64(7)) >> np.uint64(12)  # 52 bits, exact as a double
        zeros = np.minimum(52 - np.frexp(rest.astype(np.float64))[1], 52).astype(np.uint64)
        behind = (rest << (zeros + np.uint64(1))) & np.uint64((1 << 52) - 1)
        out[bucket[first]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | (behind >> np.uint64(52 - MANTISSA))
    return out.tobytes()


def _collisions(load: float) -> float:
    """Chance that two unrelated buckets of so many hashes each hold the same register."""
    zeros = np.arange(40)[:, None]
    steps = 1 << MANTISSA
    low = 2.0 ** -(zeros + 1) * (1 + np.arange(steps)[None, :] / steps)
    high = 2.0 ** -(zeros + 1) * (1 + (np.arange(steps)[None, :] + 1) / steps)
    return float(((np.exp(-load * low) - np.exp(-load * high)) ** 2).sum())


_LOADS = 2.0 ** np.arange(-7, 24)
_CHANCES = np.array([_collisions(x) for x in _LOADS])


def estimate(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of pairs of sketches (rows of a and b), corrected for collisions.

    ``sizes`` holds the mean set size of each pair. Also returns the number of buckets that either
    sketch fills, which the estimate's spread depends on.
    """
    filled = ((a | b) != 0).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    chance = np.interp(np.log2(np.maximum(sizes, 1) / REGISTERS), np.log2(_LOADS), _CHANCES)
    share = same / np.maximum(filled, 1)
    return np.maximum(0, (share - chance) / (1 - chance)), filled


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in integers."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)
