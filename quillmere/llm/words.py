"""Words of many texts at once, found and hashed over the UTF-8 bytes of an Arrow column.

A word's 64-bit hash is a sum of its bytes, each times the random 64-bit number of its place, mixed at the
end: different words collide with a chance of about 2**-57. Long words take xxh3 instead.
"""

from __future__ import annotations

import numpy as np
import xxhash

_PLACES = 512
_RNG = np.random.default_rng(20240229)
_AT_PLACE = _RNG.integers(0, 1 << 63, _PLACES + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IN_SHINGLE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between blanks.
NO_BLANK = np.ones(256, bool)
NO_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Words of letters, digits and characters beyond ASCII, in lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def find_words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of its first word (one more at the end)."""
    inside = in_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    ends[lasts] = inside[lasts]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each word, worked out in blocks of about `block` bytes."""
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    total = np.cumsum(lengths)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + block, "right")))
        n = lengths[at:upto]
        if n.max() > _PLACES:
            for i in (np.flatnonzero(n > _PLACES) + at).tolist():
                out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), 1)
            some = np.flatnonzero(n <= _PLACES) + at
        else:
            some = np.arange(at, upto)
        if len(some):
            n = lengths[some]
            first = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(first, n)
            value = (data[np.repeat(starts[some], n) + place].astype(np.uint64) + np.uint64(1)) * _AT_PLACE[place]
            out[some] = mix(np.add.reduceat(value, first) + n.astype(np.uint64) * _AT_PLACE[_PLACES])
        at = upto
    return out


def hash_starts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each of the (ascending) sizes, a hash of the first so many bytes of each word, or of all it has."""
    out, total, length = [], np.zeros(len(starts), np.uint64), (ends - starts).astype(np.uint64)
    for place in range(sizes[-1]):
        at = starts + place
        inside = at < ends
        total += np.where(inside, (data[np.minimum(at, len(data) - 1)].astype(np.uint64) + np.uint64(1)) * _AT_PLACE[place], np.uint64(0))
        if place + 1 in sizes:
            out.append(mix(total + np.minimum(length, np.uint64(place + 1)) * _IN_SHINGLE[place]))
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of k words, text by text, and the offset of each text's runs (one more at the
    end). A text of fewer than k words, but some, has its whole sequence as its only run."""
    n_words = np.diff(first)
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(offsets[-1]), np.uint64)
    full = np.flatnonzero(n_words >= k)
    if len(full):
        runs = counts[full]
        place = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
        word, to = np.repeat(first[full], runs) + place, np.repeat(offsets[full], runs) + place
        total = np.full(len(word), k, np.uint64) * _IN_SHINGLE[63]
        for j in range(k):
            total += hashes[word + j] * _IN_SHINGLE[j % 63]
        out[to] = mix(total)
    for n in range(1, k):
        short = np.flatnonzero(n_words == n)
        if len(short):
            total = np.full(len(short), n, np.uint64) * _IN_SHINGLE[63]
            for j in range(n):
                total += hashes[first[short] + j] * _IN_SHINGLE[j % 63]
            out[offsets[short]] = mix(total)
    return out, offsets
