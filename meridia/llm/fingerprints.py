"""SimHash fingerprints and MinHash bands of whole texts, computed batch by batch inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: shingles hashed at a time, so that a very long text keeps its memory bounded
_CHUNK = 255 * 512
#: bands of MinHash values and values a band: texts of similarity 0.8 share no band once in 300,000 pairs
BANDS, ROWS = 24, 4
_FACTORS = np.random.default_rng(42).integers(0, 2**63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, lowest bit first."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return total


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over word shingles; A-Z are folded, ASCII white space parts words.

    Fewer words than ``width``: the whole sequence is the one shingle. No words (or null): 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        pairs = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in pairs), dtype=np.uint64, count=to - at)
        counts += _bit_counts(hashes)
    set_bits = np.nonzero(counts * 2 > n)[0]
    return int(sum(1 << int(b) for b in set_bits))


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of the different word shingles of a text, sorted; words and short texts as for ``simhash``, none for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    width = min(width, len(words))
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1 if words else 0
    return np.unique(np.fromiter((digest(b" ".join(words[k : k + width]), seed) for k in range(n)), dtype=np.uint64, count=n))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of MinHash values; two sets that share a key are worth comparing."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048] ^ _FACTORS[1]
        part *= _FACTORS[0]
        part ^= part >> np.uint64(32)
        part *= _FACTORS[1]
        np.minimum(low, part.min(axis=1), out=low)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, ROWS))]
    return [signed(k) for k in keys]


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def set_id(hashes: np.ndarray) -> int:
    """One signed 64-bit number for a set of shingles; 0 for the empty one."""
    return signed(xxhash.xxh64_intdigest(hashes.tobytes(), 7)) if len(hashes) else 0
