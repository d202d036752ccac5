"""Words of texts as arrays: runs of bytes other than the six ASCII white-space bytes."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

from deltascope.llm.common import WORD_BREAKS, text_bytes

#: The first of the breaks that follow each other, and how many they are; a space is the only other one.
_FIRST, _MANY = np.uint8(ord("\t")), np.uint8(len(WORD_BREAKS) - 1)


def breaks(values: np.ndarray) -> np.ndarray:
    # Bytes below the first one wrap around to large numbers.
    return (values == np.uint8(ord(" "))) | (values - _FIRST < _MANY)


def split(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each word in the list of distinct words, that list, and the place of each text's first word (and the end).

    lower: A to Z count as a to z.
    """
    values, offsets = text_bytes(column)
    if lower:
        values = values + ((values - np.uint8(ord("A")) < np.uint8(26)).view(np.uint8) << np.uint8(5))
    gap = breaks(values)
    first = ~gap  # a word begins where the byte before is a break or belongs to another text
    first[1:] &= gap[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = ~gap[heads]
    starts = np.flatnonzero(first)
    places = np.searchsorted(starts, offsets)
    last = ~gap  # and ends where the byte after is a break or belongs to another text
    last[:-1] &= gap[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    last[tails] = ~gap[tails]
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(last) + 1 - starts, out=bounds[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(values[~gap]))
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, places


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word, the same in every task: a polynomial of its bytes, mixed."""
    values, offsets = text_bytes(words)
    if not len(words):
        return np.zeros(0, np.uint64)
    inside = np.arange(len(values)) - np.repeat(offsets[:-1], np.diff(offsets))
    powers = np.cumprod(np.full(int(inside.max(initial=0)) + 1, 0x9E3779B97F4A7C15 | 1, np.uint64))
    terms = np.concatenate([[np.uint64(0)], np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[inside])])
    return mix(terms[offsets[1:]] - terms[offsets[:-1]])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(codes: np.ndarray, places: np.ndarray, length: int, seed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window of `length` words within one text, and the window's 64-bit hash.

    codes: a number for each word. seed: one for each text, mixed into its windows.
    """
    sizes = np.diff(places)
    ends = np.repeat(places[1:], sizes)
    at = np.flatnonzero(np.arange(len(codes)) + length <= ends)
    key = np.zeros(len(at), np.uint64)
    if seed is not None:
        key = np.repeat(seed, sizes)[at]
    codes = codes.astype(np.uint64)
    for k in range(length):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + codes[at + k] + np.uint64(1))
    return at, key
