"""Hashed word shingles of whole texts, computed for a column of texts at once with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


#: A random value per byte, A-Z sharing those of a-z, and which bytes are white space.
_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = _U(0xD6E8FEB86659FD93)
#: Bytes handled at once, few enough for a core's cache; a single longer text is handled whole.
CHUNK = 1 << 18


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int = CHUNK):
    """Ranges of rows of about ``most`` bytes each."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) and how many each row has."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    bounds = offsets[1:-1]
    bounds = bounds[bounds < len(data)]
    first[bounds] = solid[bounds]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, _U), np.zeros(len(offsets) - 1, np.int64)
    place = np.cumsum(solid) - 1  # among solid bytes
    begin = place[at]
    size = np.diff(np.append(begin, int(place[-1]) + 1))
    within = np.arange(int(place[-1]) + 1, dtype=np.int64) - np.repeat(begin, size)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(size.max()), _STEP, _U))
        value = mix64(np.add.reduceat(_BYTE[data[solid]] * powers[within], begin) + size.astype(_U))
    return value, np.diff(np.searchsorted(at, offsets))


def shingle_sets(column: pa.Array, k: int):
    """For each row the sorted distinct 64-bit hashes of its k-word shingles.

    A row of fewer words, but one at least, has its whole sequence as its only shingle; a row
    without words has none.
    """
    data, offsets = text_buffers(column)
    for i, j in row_chunks(offsets):
        part = offsets[i : j + 1]
        words, counts = word_hashes(data[part[0] : part[-1]], part - part[0])
        ends = np.cumsum(counts)
        with np.errstate(over="ignore"):
            joined = words[: max(0, len(words) - k + 1)] * _U(3)
            for n in range(1, k):
                joined = mix64(joined + _U(n)) + words[n : n + len(joined)]
            joined = mix64(joined)
        for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
            if count >= k:
                s = np.sort(joined[end - count : end - k + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif count:
                with np.errstate(over="ignore"):
                    value = np.full(1, count, _U) * _U(0xA0761D6478BD642F)
                    for w in words[end - count : end]:
                        value = mix64(value + w)
                yield value
            else:
                yield np.zeros(0, _U)
