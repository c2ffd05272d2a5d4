"""64-bit hashes of many words or byte strings at once. Runs inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd
LONGEST = 1 << 15  # longer words are hashed one by one
_POWERS = np.cumprod(np.full(LONGEST, BASE, dtype=np.uint64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 17  # arrays for a block take some fifty times its bytes


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread each number over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space, and where each begins."""
    codes = np.frombuffer(data, dtype=np.uint8)
    hashes, begins, at = [], [], 0
    while at < len(codes):
        end = min(at + _BLOCK, len(codes))
        if end < len(codes):  # a block ends with a word
            spaces = np.flatnonzero(_SPACE[codes[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:
                later = np.flatnonzero(_SPACE[codes[end:]])
                end = end + int(later[0]) + 1 if len(later) else len(codes)
        own = codes[at:end]
        word = ~_SPACE[own]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
        first, last = edges[::2], edges[1::2]
        if len(first):
            sizes = last - first
            inside = np.flatnonzero(word)
            place = inside - np.repeat(first, sizes)
            values = BYTE_VALUES[own[inside]] * _POWERS[place & (LONGEST - 1)]
            sums = np.add.reduceat(values, np.cumsum(sizes) - sizes)
            sums = mixed(sums + sizes.astype(np.uint64) * BASE)
            for n in np.flatnonzero(sizes > LONGEST).tolist():
                digest = hashlib.blake2b(own[first[n] : last[n]].tobytes(), digest_size=8).digest()
                sums[n] = np.frombuffer(digest, np.uint64)[0]
            hashes.append(sums)
            begins.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(begins)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``size`` words.

    Words are lower-cased (A-Z alone) and separated by ASCII white space. A text of fewer words has
    its whole sequence as its only shingle; one without words has none.
    """
    encoded = [(t or "").encode().lower() for t in texts]
    ends = np.cumsum([len(e) + 1 for e in encoded])
    words, begins = word_hashes(b"\n".join(encoded))
    bounds = np.searchsorted(begins, ends)
    runs = max(len(words) - size + 1, 0)
    shingles = np.zeros(runs, dtype=np.uint64)
    for k in range(size):
        shingles = mixed(shingles) * BASE + words[k : k + runs]
    shingles = mixed(shingles)
    out, start = [], 0
    for end in bounds.tolist():
        n = end - start
        if n >= size:
            out.append(np.unique(shingles[start : end - size + 1]))
        elif n:
            h = np.full(1, n, dtype=np.uint64)
            for w in words[start:end]:
                h = mixed(h) * BASE + w
            out.append(mixed(h + np.uint64(1)))
        else:
            out.append(np.zeros(0, np.uint64))
        start = end
    return out
