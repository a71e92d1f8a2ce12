"""Whole texts through a tokenizer file, piece by piece.

A text is cut before a single blank that stands between two characters that are no white space.
The byte-level pattern never matches across such a place (a match that holds the character before
cannot go on with a blank, and one that holds the blank begins there), so the ids of a text are
those of its pieces, one after the other. A special string inside a text holds no blank, so it
stays in one piece and gets its own id, as the library does by default. For the same reason a last
full stop or comma after a letter stands for itself. The library encodes every different piece once; a worker finds pieces
it has met by a 64-bit hash, up to a limit, then starts anew. The bytes of a piece are compared with
those it was learned from; a text with a piece that differs goes through the library as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Pieces a worker remembers, about 300 bytes each.
LIMIT = 800_000
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: New pieces that go through the library as one text.
_JOINED = 24


#: Bytes of a piece that is found by its hash; longer ones are handed to the library every time.
_SHORT = 255
_RNG = np.random.default_rng(7)
_VALUE = _RNG.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """64-bit hashes of many stretches of a buffer, by sums of random byte values times powers."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(raw) >= len(self.up):
            n = len(raw) * 5 // 4 + 2
            self.up, self.down = _powers(n, _BASE), _powers(n, np.uint64(pow(int(_BASE), -1, 2**64)))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[raw] * self.up[: len(raw)], out=sums[1:])
        return (sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64)


_ONES = np.uint64(2**64 - 1)


def _eight(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the last byte."""
    return np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))


def _differ(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether stretches of `size` bytes differ, _SHORT bytes of each at most; a and b are what _eight returns."""
    out, some = np.zeros(len(size), bool), np.arange(len(size))
    for k in range(0, _SHORT, 8):
        some = some[size[some] > k]
        if not len(some):
            break
        ones = _ONES >> (np.uint64(64) - np.uint64(8) * np.minimum(size[some] - k, 8).astype(np.uint64))
        out[some] |= ((a[at_a[some] + k] ^ b[at_b[some] + k]) & ones) != 0
    return out


class _Column:
    """A numpy column that grows; one entry at least is spare."""

    def __init__(self, kind: type):
        self.x, self.n = np.zeros(1024, kind), 0

    def add(self, values) -> None:
        n = self.n + len(values)
        if n >= len(self.x):
            self.x = np.concatenate([self.x[: self.n], np.zeros(2 * n - self.n, self.x.dtype)])
        self.x[self.n : n] = values
        self.n = n


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, remembering pieces."""

    _loaded: dict[str, PieceEncoder] = {}

    def __init__(self, path: str, limit: int = LIMIT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # a character of a byte-level token is a byte
            self.width[i] = len(token)
        self.marks = self._batch([".", ","])
        self.limit, self.hasher = limit, _Hasher()
        self._reset()

    @classmethod
    def load(cls, path: str) -> PieceEncoder:
        """The one of this worker."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _reset(self) -> None:
        self.keys, self.codes, self.stems = np.empty(0, np.uint64), np.empty(0, np.int64), {}
        # of pieces: their stem, and the id of the mark after it or -1; of stems: where their ids are in flat
        self.stem, self.mark, self.odd = _Column(np.int32), _Column(np.int32), _Column(bool)
        self.start, self.size, self.flat = _Column(np.int64), _Column(np.int32), _Column(np.uint32)
        # what pieces were learned from: where their bytes are in raw, how many, and whether they head a text
        self.raw, self.where, self.bytes, self.heads = _Column(np.uint8), _Column(np.int64), _Column(np.int64), _Column(bool)

    def _batch(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            out += e.ids
        return out

    def _add(self, stems: list, ids: list[int], widths: list[int]) -> None:
        """Remember stems whose ids follow one another; widths are their lengths in bytes."""
        found = np.array(ids, np.uint32)
        ends = np.searchsorted(np.cumsum(self.width[found]), np.cumsum(widths), side="left") + 1
        starts = np.r_[0, ends[:-1]]
        self.stems.update(zip(stems, range(len(self.stems), len(self.stems) + len(stems)), strict=True))
        self.start.add(self.flat.n + starts)
        self.size.add(ends - starts)
        self.flat.add(found)

    def _learn(self, new: list[str | tuple[str]]) -> None:
        """Remember pieces: a str stands after a blank, a tuple holds the head of a text."""
        stems, marks, odd = [], [], []
        full_stop, comma = self.marks
        for p in new:
            mark, bad = -1, False
            if type(p) is tuple:
                bad = not p[0] or p[0][0].isspace() or p[0][-1].isspace()
            else:
                bad = not p or p[0].isspace() or p[-1].isspace()
                if bad:
                    p = ""
                elif (end := p[-1]) in ".," and len(p) > 1 and p[-2] < "ɐ" and p[-2].isalpha():
                    p, mark = p[:-1], full_stop if end == "." else comma
            stems.append(p)
            marks.append(mark)
            odd.append(bad)
        unknown = [u for u in dict.fromkeys(stems) if u not in self.stems]
        # units after a blank that neither begin nor end with white space may share a text
        units = [u for u in unknown if type(u) is str and u]
        if units:
            joined = [" " + " ".join(units[i : i + _JOINED]) for i in range(0, len(units), _JOINED)]
            self._add(units, self._batch(joined), [1 + len(u.encode()) for u in units])
        heads = [u for u in unknown if type(u) is tuple and u[0]]
        if heads:
            self._add(heads, self._batch([u[0] for u in heads]), [len(u[0].encode()) for u in heads])
        for u in unknown:
            if not u or not u[0]:
                self.stems[u] = len(self.stems)
                self.start.add([0])
                self.size.add([0])
        self.stem.add(list(map(self.stems.__getitem__, stems)))
        self.mark.add(marks)
        self.odd.add(odd)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return self.encode_all([text])[0]

    def stream(self, texts: Iterable[str], chars: int = 1_000_000) -> Iterator[np.ndarray]:
        """The ids of whole texts, some at a time."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= chars:
                yield from self.encode_all(held)
                held, size = [], 0
        yield from self.encode_all(held)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts."""
        if not texts:
            return []
        if len(self.codes) >= self.limit:
            self._reset()
        raws = [t.encode() for t in texts]
        buffer = b"".join(raws)
        raw = np.frombuffer(buffer, np.uint8)
        last = np.cumsum([len(r) for r in raws])
        # pieces begin at each text and after each blank, and end at the next blank or the text's end
        blanks = np.flatnonzero(raw == 32)
        begin = np.concatenate([np.r_[0, last[:-1]], blanks + 1]).astype(np.int64)
        end = np.concatenate([blanks, last]).astype(np.int64)
        head = np.r_[np.ones(len(raws), bool), np.zeros(len(blanks), bool)]
        # what follows a text's last blank ends the text and so comes before the next text's head
        order = np.lexsort((head, begin))
        begin, head, end = begin[order], head[order], np.sort(end, kind="stable")
        key = self.hasher(raw, begin, end) + head.astype(np.uint64) * _BASE
        first_piece = np.flatnonzero(head)
        values, at, back = np.unique(key, return_index=True, return_inverse=True)
        near = np.minimum(np.searchsorted(self.keys, values), max(len(self.keys) - 1, 0))
        known = self.keys[near] == values if len(self.keys) else np.zeros(len(values), bool)
        codes = np.empty(len(values), np.int64)
        codes[known] = self.codes[near[known]]
        # what has a hash must have the bytes of the first that had it, in this call and before
        length, here, same = end - begin, _eight(raw), at[back]
        other = (length != length[same]) | (head != head[same]) | _differ(here, begin, here, begin[same], np.where(same == np.arange(len(same)), 0, length))
        met, piece = at[known], codes[known]
        changed = (length[met] != self.bytes.x[piece]) | (head[met] != self.heads.x[piece])
        wrong = np.zeros(len(values), bool)
        wrong[known] = changed | _differ(here, begin[met], _eight(self.raw.x[: self.raw.n]), self.where.x[piece], np.where(changed, 0, length[met]))
        other |= wrong[back]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            pieces = [buffer[a:b].decode() for a, b in zip(begin[at[fresh]].tolist(), end[at[fresh]].tolist(), strict=True)]
            new = [(p,) if h else p for p, h in zip(pieces, head[at[fresh]].tolist(), strict=True)]
            codes[fresh] = np.arange(self.stem.n, self.stem.n + len(new))
            places = np.searchsorted(self.keys, values[fresh])
            self.keys, self.codes = np.insert(self.keys, places, values[fresh]), np.insert(self.codes, places, codes[fresh])
            kept = np.minimum(length[at[fresh]], _SHORT)
            first = np.cumsum(kept) - kept
            self.where.add(self.raw.n + first)
            self.bytes.add(length[at[fresh]])
            self.heads.add(head[at[fresh]])
            self.raw.add(raw[np.repeat(begin[at[fresh]] - first, kept) + np.arange(int(kept.sum()))])
            self._learn(new)
        codes = codes[back]
        odd = np.logical_or.reduceat(self.odd.x[codes] | other | (length > _SHORT), first_piece)
        ids, ends = self._gather(codes)
        bounds = np.r_[0, ends[np.r_[first_piece[1:], len(codes)] - 1]]
        return [
            self._plain(text) if bad or not text else ids[a:b]
            for text, bad, a, b in zip(texts, odd, bounds[:-1], bounds[1:], strict=True)
        ]

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and where each piece ends."""
        stem, mark = self.stem.x[codes], self.mark.x[codes]
        size = self.size.x[stem] + (mark >= 0)
        ends = np.cumsum(size)
        at = np.repeat(self.start.x[stem] - (ends - size), size)
        at += np.arange(len(at))
        out = self.flat.x[at]  # a mark's place holds what follows the stem, until it is set
        out[ends[mark >= 0] - 1] = mark[mark >= 0]
        return out, ends

    def _plain(self, text: str) -> np.ndarray:
        """Texts with white space next to a blank, cut at safe places only."""
        parts = cut(text)
        return np.array(self._batch(parts), np.uint32)


def cut(text: str) -> list[str]:
    """The text cut at every safe place; joined, the parts are the text."""
    return _CUT.split(text) if text else []
