"""Word shingles and SuperMinHash signatures of texts, as arrays."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_digest, xxh3_128_digest

SHINGLE = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambling of each number (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's 5-word shingles.

    Only A-Z are lower-cased and words end at ASCII blanks, as bytes.lower and bytes.split do. Fewer than five words
    make one shingle; no words make none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.frombuffer(b"".join(map(xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)
    n = min(SHINGLE, len(h))
    total = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        total = mixed(total * _BASE + h[i : len(h) - n + 1 + i])
    return np.unique(total)


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that name the set."""
    return xxh3_128_digest(shingles.tobytes())


def super_minhash(shingles: np.ndarray, size: int = 128) -> np.ndarray:
    """The SuperMinHash signature of a non-empty set: size values, equal in two sets' signatures as often as their
    Jaccard similarity says, with less variance than independent minima.

    Each element draws a random permutation of the slots, one place after the other (Fisher-Yates), and at place j
    offers j + u, u uniform in [0, 1), to that slot; a slot keeps the least offer. Values are j << 32 | u. No later
    place can lower a slot that holds less than j, so drawing stops at the first j above all slots: after two or
    three places in texts of some hundred shingles.
    """
    slots = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    state, order = shingles, None
    for j in range(size):
        if j and int(slots.max() >> np.uint64(32)) < j:
            break
        state = state + _STEP
        draw = mixed(state)
        pick = (((draw & low) * np.uint64(size - j)) >> np.uint64(32)).astype(np.int64) + j
        if j == 0:
            slot = first = pick
        else:
            if order is None:
                order = np.broadcast_to(np.arange(size, dtype=np.uint16), (len(shingles), size)).copy()
                rows = np.arange(len(shingles))
                order[rows, first] = 0
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, j]
        np.minimum.at(slots, slot, (draw >> np.uint64(32)) | np.uint64(j << 32))
    return slots


def band_keys(signature: np.ndarray, rows: int = 4) -> np.ndarray:
    """One 64-bit key for each run of `rows` slots; keys of different runs don't meet."""
    runs = signature.reshape(-1, rows)
    total = mixed(np.arange(1, len(runs) + 1, dtype=np.uint64) * _STEP)
    for i in range(rows):
        total = mixed(total * _BASE + runs[:, i])
    return total
