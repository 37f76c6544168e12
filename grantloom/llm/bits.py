"""Packing whole numbers in a fixed number of bits, least significant bit first."""

from __future__ import annotations

import numpy as np


def width_for(values: int) -> int:
    """The fewest bits that tell so many values apart."""
    return max(1, int(values - 1).bit_length())


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """64-bit words that hold the values, width bits each (up to 64); one spare word at the end."""
    values = np.asarray(values).astype(np.uint64)
    words = np.zeros((len(values) * width + 63) // 64 + 1, np.uint64)
    if not len(values):
        return words
    at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
    word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    # A word's values don't overlap, so sums are as good as ors; the values of a word are adjacent.
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(values << bit, first)
    over = np.flatnonzero(bit.astype(np.int64) + width > 64)
    words[word[over] + 1] |= values[over] >> (np.uint64(64) - bit[over])
    return words


def unpack(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The values with these numbers."""
    place = np.asarray(at).astype(np.uint64) * np.uint64(width)
    word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
    low = words[word] >> bit
    high = np.where(bit == 0, np.uint64(0), words[word + 1] << ((np.uint64(64) - bit) & np.uint64(63)))
    mask = np.uint64(2**width - 1)
    return (low | high) & mask
