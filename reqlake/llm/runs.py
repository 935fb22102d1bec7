"""Maximal runs of chosen bytes in whole Arrow columns of texts, found by numpy passes over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import text_bytes
from .textkit import LOWER

ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[0x41:0x5B] = ASCII_LETTER[0x61:0x7B] = True
TERM = ASCII_LETTER.copy()
TERM[0x30:0x3A] = TERM[0x80:] = True  # digits, and all bytes of characters beyond ASCII
LATIN = 0xC3  #: the first byte of U+00C0 to U+00FF; the second is 0x40 less than the code point


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``inside``, and n + 1 offsets of the texts into the runs; none crosses texts."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    edges = offsets[1:-1]
    before[edges[edges < len(inside)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def binary_array(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``flat`` as Arrow binaries."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII as binaries, and n + 1 offsets of the texts."""
    data, offsets = text_bytes(column)
    inside = TERM[data]
    starts, ends, at = spans(inside, offsets)
    return binary_array(LOWER[data[inside]], ends - starts), at


def latin_runs(column: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of [A-Za-zÀ-ÿ] of ``least`` code points or more, A-Z lower-cased.

    (data, start, end, length, text): the texts' lower-cased UTF-8 bytes, each run's place in them, its code points and its text.
    """
    data, offsets = text_bytes(column)
    lead = data == LATIN
    inside = ASCII_LETTER[data] | lead
    inside[1:] |= lead[:-1]
    starts, ends, at = spans(inside, offsets)
    leads = np.append(0, np.cumsum(lead))
    lengths = ends - starts - (leads[ends] - leads[starts])
    keep = lengths >= least
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    # the second byte of a character stays as it is: LOWER changes bytes below 0x80 only
    return LOWER[data], starts[keep], ends[keep], lengths[keep], text[keep]


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of all pieces, one after another."""
    first = np.cumsum(lengths) - lengths
    return data[np.repeat(starts - first, lengths) + np.arange(lengths.sum())]
