"""Words of many texts at once, as 64-bit hashes, straight from the bytes of Arrow string columns.

A word is a maximal run of word bytes of its kind. Its hash takes in eight bytes at a time and its
length; texts are hashed a tile at a time, so memory does not grow with a batch or with a text, and
nothing is kept from one batch to the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix

#: Bytes that are hashed at a time; a longer word makes a longer tile.
TILE = 1 << 18
_BYTES = np.arange(256)
_ONES = np.uint64(2**64 - 1)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes inside words: all but ASCII white space; 0-9, A-Z, a-z and everything from U+0080.
BLANK = (_BYTES != 32) & ((_BYTES < 9) | (_BYTES > 13))
ALNUM = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each row begins and the last one ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, at


def _tile(raw: np.ndarray, breaks: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of a stretch; no word goes on across a break."""
    word = inside[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    breaks = breaks[breaks < len(raw)]
    first[breaks] = word[breaks]
    begin = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    size = np.flatnonzero(last) + 1 - begin
    lower = np.concatenate([_LOWER[raw], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", lower, 0, (1,))
    h, some, k = mix(size.astype(np.uint64)), np.arange(len(begin)), 0
    while len(some):
        rest = np.minimum(size[some] - k, 8).astype(np.uint64)
        x = eight[begin[some] + k] & (_ONES >> (np.uint64(64) - np.uint64(8) * rest))
        h[some] = mix(h[some] ^ x)
        k += 8
        some = some[size[some] > k]
    return h, begin


def hashed(column: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a string column, one row after the other, and the count of each row's words."""
    raw, at = bytes_of(column)
    hashes, begins = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    low, last = int(at[0]), int(at[-1])
    while low < last:
        high = min(low + TILE, last)
        # a tile ends with a row, or within a row before a byte that is in no word
        row = int(at[np.searchsorted(at, high, side="right") - 1])
        if row > low:
            high = row
        else:
            place, high = high, int(at[np.searchsorted(at, low, side="right")])
            while place < high:
                free = np.flatnonzero(~inside[raw[place : min(place + 4096, high)]])
                if len(free):
                    high = place + int(free[0])
                place += 4096
            high = max(high, low + 1)
        h, b = _tile(raw[low:high], at[np.searchsorted(at, low) : np.searchsorted(at, high)] - low, inside)
        hashes.append(h)
        begins.append(b + low)
        low = high
    begin = np.concatenate(begins)
    edges = np.searchsorted(begin, at)
    return np.concatenate(hashes), np.diff(edges)


def counts(column: pa.Array, inside: np.ndarray) -> np.ndarray:
    """The count of each row's words."""
    raw, at = bytes_of(column)
    heads, low, last = np.zeros(len(at), np.int64), int(at[0]), int(at[-1])
    while low < last:  # tiles of TILE bytes; a row's words so far are those that begin before its end
        high = min(low + TILE, last)
        word = inside[raw[low:high]]
        first = word.copy()
        first[1:] &= ~word[:-1]
        first[0] &= low == int(at[0]) or not inside[raw[low - 1]]
        rows = at[np.searchsorted(at, low) : np.searchsorted(at, high)] - low
        first[rows] = word[rows]
        sums = np.r_[0, np.cumsum(first)]
        heads += sums[np.clip(at - low, 0, high - low)]
        low = high
    return np.diff(heads)


def slices(columns: list[pa.Array], size: int = 1 << 22) -> list[tuple[int, int]]:
    """Ranges of rows with at most `size` bytes in the string columns, or a single row."""
    ends = sum(bytes_of(c)[1][1:] - bytes_of(c)[1][0] for c in columns)
    out, i = [], 0
    while i < len(ends):
        held = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, held + size, side="right")))
        out.append((i, j))
        i = j
    return out
