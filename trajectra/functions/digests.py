"""md5 of many short messages at once: each step of the digest is one operation on arrays of all of them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np

_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_PLACES = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _block(words: list[np.ndarray | int]) -> np.ndarray:
    """(n, 4) words of the digests of one block each; a word that all share is a number."""
    n = next(len(w) for w in words if not isinstance(w, int))
    a, b, c, d = (np.full(n, x) for x in _START)
    f, high = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i, (place, turn) in enumerate(zip(_PLACES, _TURNS, strict=True)):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if isinstance(words[place], int):
            f += np.uint32((_SINES[i] + words[place]) & 0xFFFFFFFF)
        else:
            f += words[place]
            f += np.uint32(_SINES[i])
        np.right_shift(f, np.uint32(32 - turn), out=high)
        f <<= np.uint32(turn)
        f |= high
        f += b
        a, b, c, d, f = d, f, b, c, a
    return np.stack([x + s for x, s in zip((a, b, c, d), _START, strict=True)], axis=1)


def md5(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """The 16 bytes of md5(head + tail) by tail and head."""
    most = max(map(len, heads)) + max(map(len, tails))
    if most > 55:  # more than one block
        raw = b"".join(hashlib.md5(h + t).digest() for t in tails for h in heads)
        return np.frombuffer(raw, np.uint8).reshape(len(tails), len(heads), 16)
    used = most // 4 + 1
    text = np.zeros((len(tails), len(heads), 4 * used), np.uint8)
    bits = np.empty((len(tails), len(heads)), np.uint32)
    # stretches of neighbours of one length are written at once
    for a, before in _stretches(heads):
        for b, after in _stretches(tails):
            m, n = len(before[0]), len(before[0]) + len(after[0])
            part = text[b : b + len(after), a : a + len(before)]
            part[:, :, :m] = np.frombuffer(b"".join(before), np.uint8).reshape(1, len(before), m)
            part[:, :, m:n] = np.frombuffer(b"".join(after), np.uint8).reshape(len(after), 1, n - m)
            part[:, :, n] = 0x80
            bits[b : b + len(after), a : a + len(before)] = 8 * n
    words: list = [0] * 16
    words[:used] = np.ascontiguousarray(text.reshape(-1, 4 * used).view("<u4").T)
    words[14] = bits.ravel()
    return _block(words).view(np.uint8).reshape(len(tails), len(heads), 16)


def _stretches(parts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    for _, same in groupby(parts, len):
        found = list(same)
        yield at, found
        at += len(found)
