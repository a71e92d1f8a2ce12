"""Token counts of whole texts, by merging many pre-tokens at once in ragged numpy arrays.

For tokenizer files of the kind of word_bpe_49k.json: special strings are taken out of the raw text and
count one each; the rest is brought to NFC and to lower case character by character, and cut into
contractions, runs of letters, single numerals and runs of anything else but white space; a pre-token's
bytes are its symbols, the last one with the mark of a word's end, and pairs of symbols are merged by rank.

Different pre-tokens of a slice lie one after the other in one array of symbols. In each round every
pre-token applies its pair of lowest rank, wherever it stands in it (of overlapping places the first, third,
...), until no pair has a rank; the symbols left are counted. That equals merging one place at a time, as a
merge's result never is part of a pair of lower rank; a file for which this does not hold is refused. Pre-tokens
of more than LONG bytes go through the ranks once, each with the places that wait for it, so a text without
white space takes no longer than its length warrants. A worker remembers counts of LIMIT pre-tokens of at most
LONG bytes, then starts anew.

Edge cases: a null text counts as empty and has no bytes and no tokens; repeated rows are counted alike and
rows with equal doc_id are separate documents; very long texts are normalised and cut in parts that end before a
blank, and a stretch without blanks as one; characters that are newer than Python's tables are normalised and cut
by the library; only doc_id and the text are looked at, whatever other columns are named; an empty
table returns no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common, words

#: Tokens above which a document does not fit a context.
MAX_TOKENS = 2048
#: Pre-tokens a worker remembers, and the bytes above which one is merged on its own and forgotten.
LIMIT, LONG = 500_000, 128
#: Characters of the parts that long texts are cut into, and bytes of the texts that are counted together.
CHUNK, SLICE = 200_000, 2_000_000
_NEVER = 1 << 40

#: What is taken of a tokenizer file; others are refused. Fixed values of the format.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def _newer(text: str) -> bool:
    """Whether a text holds characters that Python's Unicode tables do not know."""
    return any(unicodedata.category(c) == "Cn" for c in set(text))


class TokenCounter:
    """Counts by one tokenizer file."""

    _loaded: dict[str, TokenCounter] = {}

    def __init__(self, path: str, limit: int = LIMIT):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if (spec["normalizer"].get("normalizers"), split["pattern"]["Regex"], model["type"]) != (_NORMALIZER, _SPLIT, "BPE"):
            raise ValueError(f"{path} is of another kind")
        self.path, self.limit, self.known = path, limit, {}
        self.find = regex.compile(_SPLIT).findall
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))).split
        self.library = Tokenizer.from_file(path)
        # symbols and merges as numbers; a symbol that the vocabulary lacks is dropped
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner, self.last = (np.array([vocab.get(c + mark, -1) for c in byte_symbols()], np.int64) for mark in ("", end))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        of = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        made, used = np.full(self.size, -1), np.full(self.size, _NEVER)
        np.maximum.at(made, of[:, 2], np.arange(len(of)))
        for side in (0, 1):
            np.minimum.at(used, of[:, side], np.arange(len(of)))
        if (made >= used).any():
            raise ValueError(f"{path} merges a token before it is made")
        key = of[:, 0] * self.size + of[:, 1]
        order = np.argsort(key)
        self.keys, self.ranks, self.result = key[order], order, of[:, 2]

    @classmethod
    def load(cls, path: str) -> TokenCounter:
        """The one of this worker."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NEVER where there is none."""
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], _NEVER)

    def symbols(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of pre-tokens (at least one byte each), one after the other, and the pre-token of each."""
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        size = np.array([len(t) for t in tokens], np.int64)
        out = self.inner[raw]
        ends = np.cumsum(size) - 1
        out[ends] = self.last[raw[ends]]
        of = np.repeat(np.arange(len(tokens)), size)
        return out[out >= 0], of[out >= 0]

    def merged(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols are left of each pre-token."""
        left = np.zeros(len(tokens), np.int64)
        sym, of = self.symbols(tokens)
        while len(sym):
            rank = np.where(of[1:] == of[:-1], self._rank(sym[:-1], sym[1:]), _NEVER)
            head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            best = np.minimum.reduceat(np.r_[rank, _NEVER], head)  # of each pre-token; a pair's rank stands at its first symbol
            n = np.diff(np.r_[head, len(sym)])
            over = best == _NEVER
            left[of[head[over]]] = n[over]
            here = np.flatnonzero((rank == np.repeat(best, n)[:-1]) & (rank < _NEVER))
            here = _apart(here, np.diff(here) == 1)
            sym[here] = self.result[rank[here]]
            keep = np.repeat(~over, n)
            keep[here + 1] = False
            sym, of = sym[keep], of[keep]
        return left

    def merged_long(self, token: bytes) -> int:
        """How many symbols are left of one long pre-token: rank by rank, each with the places that wait for it."""
        sym, _ = self.symbols([token])
        n = len(sym)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n + 1, bool)
        alive[n] = False
        waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[after[at] < n]
            rank = self._rank(sym[at], sym[after[at]])
            at, rank = at[rank < _NEVER], rank[rank < _NEVER]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(rank)) + 1):
                if len(part):
                    r = int(rank[part[0]])
                    if r not in waiting:
                        heapq.heappush(heap, r)
                    waiting[r].append(at[part])

        wait(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at]]
            at = at[after[at] < n]
            at = at[self._rank(sym[at], sym[after[at]]) == r]
            at = _apart(at, after[at[:-1]] == at[1:])
            if not len(at):
                continue
            gone = after[at]
            sym[at], alive[gone], after[at] = self.result[r], False, after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            ahead = before[at]
            wait(np.unique(np.concatenate([at, ahead[ahead >= 0]])))
        return int(alive.sum())

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if not text.isascii():
            if _newer(text):
                of = self.library
                # byte-level symbols back to text
                back = {c: b for b, c in enumerate(byte_symbols())}
                found = of.pre_tokenizer.pre_tokenize_str(of.normalizer.normalize_str(text))
                return [bytes(back[c] for c in word).decode() for word, _ in found]
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # which Python lowers by what follows
        return self.find(text.lower())

    def count_all(self, texts: Iterable[str]) -> list[int]:
        """Token counts of whole texts."""
        found, special, new = [], [], set()
        if len(self.known) > self.limit:
            self.known = {}
        for text in texts:
            parts = self.split(text) if any(x in text for x in self.special) else [text]
            special.append(len(parts) - 1)
            own = [w for p in parts for chunk in bpe.chunks(p, CHUNK) for w in self.pretokens(chunk)]
            new.update(set(own).difference(self.known))
            found.append(own)
        fresh = sorted(new)
        raw = [w.encode() for w in fresh]
        long = {w: self.merged_long(r) for w, r in zip(fresh, raw, strict=True) if len(r) > LONG}
        short = [i for i, r in enumerate(raw) if len(r) <= LONG]
        self.known.update(zip((fresh[i] for i in short), self.merged([raw[i] for i in short]).tolist(), strict=True))
        of = self.known if not long else self.known | long
        return [sum(map(of.__getitem__, own)) + s for own, s in zip(found, special, strict=True)]


def _apart(at: np.ndarray, touches: np.ndarray) -> np.ndarray:
    """Of each run of places that overlap (touches: the next one) the first, third, ..."""
    if not len(at):
        return at
    k = np.arange(len(at))
    first = np.maximum.accumulate(np.where(np.r_[True, ~touches], k, 0))
    return at[(k - first) % 2 == 0]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count(docs: DataFrame, tokenizer_path: str, most: int = MAX_TOKENS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.load(tokenizer_path)
        for batch in batches:
            for i, j in words.slices([batch["text"]], SLICE):
                rows = batch.slice(i, j - i)
                _, at = words.bytes_of(rows["text"])
                n = np.array(counter.count_all(t or "" for t in rows["text"].to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(np.diff(at)), pa.array(n), pa.array(n > most)], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
