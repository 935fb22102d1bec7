"""Words and word shingles of whole Arrow columns, as numpy passes over the bytes.

Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D) and A-Z is lower-cased, so both are exact on
UTF-8 bytes.  Words and shingles are named by 64-bit hashes.  A word's is a sum of its bytes' values times a multiplier of
each place; the multipliers are mixed one by one and are no powers of a base, so repetitive words (Thue-Morse words, say)
do not cancel out.  Among n distinct shingles two share a name with a probability of about n*n / 2**64.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_random = np.random.default_rng(20240917)
_BYTE = _random.integers(1, (1 << 64) - 1, 256, np.uint64)
_BYTE[SPACE] = 0
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, key: int = 0) -> np.ndarray:
    """A keyed bijection of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64) + np.uint64((_STEP * (2 * key + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACE = mix(np.arange(4096), 7) | np.uint64(1)


def _multipliers(n: int) -> np.ndarray:
    return _PLACE[:n] if n <= len(_PLACE) else mix(np.arange(n), 7) | np.uint64(1)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and n + 1 offsets of the texts into the words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z lower-cased), and n + 1 offsets of the texts into them."""
    starts, ends, at = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), at
    lengths = ends - starts
    run = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, run)
    value = _BYTE[LOWER[data[starts[0] :]]] * _multipliers(int(run.max()))[place]
    return mix(np.add.reduceat(value, starts - starts[0]) + lengths.astype(np.uint64), 1), at


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles with repeats, and n + 1 offsets of the texts into them.

    A text of 1 to k - 1 words has its whole sequence as its one shingle; a text without words has none.
    """
    n_words = np.diff(at)
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    out_at = np.concatenate([[0], np.cumsum(counts)])
    if not out_at[-1]:
        return np.zeros(0, np.uint64), out_at
    factors = mix(np.arange(k), 3) | np.uint64(1)
    whole = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i, f in enumerate(factors):
        whole += words[i : i + len(whole)] * f
    first = np.repeat(at[:-1], counts) + np.arange(out_at[-1]) - np.repeat(out_at[:-1], counts)
    out = np.zeros(out_at[-1], np.uint64)
    full = np.repeat(n_words >= k, counts)
    out[full] = whole[first[full]]
    for m in range(1, k):
        short = np.flatnonzero(n_words == m)
        total = np.full(len(short), m * 77 + 5, np.uint64)
        for i in range(m):
            total += words[at[short] + i] * factors[i]
        out[out_at[short]] = total
    return mix(out, 2), out_at
