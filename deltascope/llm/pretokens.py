"""Pre-tokenisation without regular expressions.

Every code point gets a class from a table. An automaton of eight states walks the classes and says before
which characters a pre-token begins. A stretch of text is a function from state to state and such functions
compose associatively, so all stretches are evaluated side by side, composed by a doubling scan, and
evaluated once more from their true first states. The pre-tokens are those of `public_tokenizers.PATTERN`.
"""
from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

from deltascope.llm.common import text_bytes

#: White_Space of Unicode, as `\s` of the tokenizers' pattern reads it.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions of the pattern, in lower case only, after an apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

LETTER, NUMBER, OTHER, SPACE, BLANK, APOSTROPHE = range(6)
#: What the automaton reads: a class, or a contraction's apostrophe, or white space by what follows it.
ON_LETTER, ON_NUMBER, ON_OTHER, ON_SHORT, ON_LONG, ON_WHITE, ON_LAST_SPACE, ON_LAST_BLANK = range(8)
#: States: a pre-token has ended; in letters, numbers, others, white space; a space that joins what follows; one or two characters of a contraction to go.
ENDED, LETTERS, NUMBERS, OTHERS, WHITE, JOINS, ONE_LEFT, TWO_LEFT = range(8)
STRETCH = 128


@functools.cache
def class_table() -> np.ndarray:
    """Class of each code point."""
    general = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), np.uint8)[::2]
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    kinds[general == ord("L")] = LETTER
    kinds[general == ord("N")] = NUMBER
    kinds[WHITE_SPACE] = BLANK
    kinds[0x20], kinds[0x27] = SPACE, APOSTROPHE
    return kinds


@functools.cache
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token begins, by what is read and the state. Rows from 8 on: at the first character of a text, whatever came before."""
    following = np.zeros((16, 8), dtype=np.uint8)
    begins = np.ones((16, 8), dtype=bool)
    for read, run in ((ON_LETTER, LETTERS), (ON_NUMBER, NUMBERS), (ON_OTHER, OTHERS), (ON_WHITE, WHITE)):
        following[read] = run
        begins[read, run] = False
        if read != ON_WHITE:
            begins[read, JOINS] = False
    for read, left in ((ON_SHORT, ONE_LEFT), (ON_LONG, TWO_LEFT)):
        following[read] = left
        for state in (OTHERS, JOINS):
            following[read, state], begins[read, state] = OTHERS, False
    following[ON_LAST_SPACE], following[ON_LAST_BLANK] = JOINS, ENDED
    following[:8, TWO_LEFT], following[:8, ONE_LEFT] = ONE_LEFT, ENDED
    begins[:8, [ONE_LEFT, TWO_LEFT]] = False
    following[8:] = following[:8, [ENDED]]
    return following, begins


def read_symbols(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What the automaton reads at each character; `first` marks the first characters of texts."""
    kinds = class_table()[codes]
    last = np.append(first[1:], True)
    white = (kinds == SPACE) | (kinds == BLANK)
    ink_next = np.append(~white[1:], False) & ~last
    symbols = np.array([ON_LETTER, ON_NUMBER, ON_OTHER, ON_WHITE, ON_WHITE, ON_OTHER], dtype=np.uint8)[kinds]
    symbols[(kinds == SPACE) & ink_next] = ON_LAST_SPACE
    symbols[(kinds == BLANK) & ink_next] = ON_LAST_BLANK
    for place in np.flatnonzero(kinds == APOSTROPHE):
        for word in CONTRACTIONS:
            end = place + 1 + len(word)
            if end <= len(codes) and not first[place + 1 : end].any() and all(codes[place + 1 + i] == ord(c) for i, c in enumerate(word)):
                symbols[place] = ON_SHORT if len(word) == 1 else ON_LONG
                break
    symbols[first] += 8
    return symbols


def scan(symbols: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each character."""
    following, begins = transitions()
    rows = -(-len(symbols) // STRETCH)
    padded = np.full(rows * STRETCH, ON_LETTER, dtype=np.uint8)
    padded[: len(symbols)] = symbols
    columns = np.ascontiguousarray(padded.reshape(rows, STRETCH).T)
    flat = following.ravel()
    ends = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in columns:
        ends = flat[(column.astype(np.intp) * 8)[:, None] + ends]
    step = 1
    while step < rows:  # ends[i] becomes the composition of all stretches up to i
        later = ends.copy()
        later[step:] = np.take_along_axis(ends[step:], ends[:-step], axis=1)
        ends, step = later, step * 2
    states = np.concatenate([[ENDED], ends[:-1, ENDED]]).astype(np.intp)
    out = np.empty((STRETCH, rows), dtype=bool)
    mark = begins.ravel()
    for k, column in enumerate(columns):
        at = column.astype(np.intp) * 8 + states
        out[k] = mark[at]
        states = flat[at].astype(np.intp)
    return out.T.ravel()[: len(symbols)]


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of some texts as one array over the same bytes, and the place of each text's first one (and the end)."""
    values, offsets = text_bytes(column)
    codes = np.frombuffer(values.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    filled = offsets[:-1][np.diff(offsets) > 0]
    lead = np.flatnonzero((values & 0xC0) != 0x80)  # the byte at which each character begins
    first = np.zeros(len(codes), dtype=bool)
    first[np.searchsorted(lead, filled)] = True
    if not len(codes):
        return pa.array([], pa.string()), np.zeros(len(offsets), np.int64)
    starts = lead[scan(read_symbols(codes, first))]
    places = np.searchsorted(starts, offsets)
    bounds = np.append(starts, len(values)).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(values))
    return tokens, places
