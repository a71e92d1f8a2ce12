"""Benchmark decontamination with a distributed positional inverted index.

The training documents are indexed in segments. A segment holds the postings of all its tokens:
sorted term hashes, and for each term the ascending positions of its tokens, counted through the
segment with a gap between documents that no phrase can bridge. Segments are rows of a written
table, so one index serves any number of test sets.

Phrases are looked up in a segment all at once: those with a term that does not occur go first, and
then the lists of the others are intersected, each shifted by its term's offset, from the phrase's
rarest term to its most frequent one. `search` counts what exact phrases hit, `matches` returns where
they are, and `proximity` where all terms of a phrase stand within a slop of its rarest one. The
phrases of the test set go to the segments in blocks of at most PHRASES words, so what a task is sent
has a fixed bound; each block reads the index once.

Terms are told apart by 64-bit hashes. Words are runs of 0-9, a-z (A-Z lower-cased) and
code points from U+0080.

Edge cases: a null or empty text has no words and is never hit; an item without words makes no
phrase; an item of fewer than WINDOW words makes one phrase; items with equal item_id count once;
items with a null item_id hit words but are not listed; rows with equal doc_id are separate
documents; an empty test set leaves every document clean, and an empty table has no rows; a text of
any length is in one segment, so that no phrase is cut; other columns are not looked at. A word that
several windows hit counts once, and the order of rows or items makes no difference.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

WINDOW = 10
#: Positions (words, and the gaps between documents) after which a segment is closed; a longer
#: document makes a segment of its own.
SEGMENT = 1_000_000
#: Words of test items sent to the segments at a time, and occurrences of terms that are followed at a time.
PHRASES, FOLLOWED = 500_000, 500_000
_SEGMENT = "uid binary, doc_ids binary, there binary, firsts binary, sizes binary, terms binary, starts binary, positions binary"
_GAP = 64


def build(docs: DataFrame, segment_size: int = SEGMENT) -> DataFrame:
    """The segments of an index over (doc_id, text); write them before use."""
    schema = pa.schema([(x.split()[0], pa.binary()) for x in _SEGMENT.split(", ")])

    def segment(ids: list[pa.Array], hashes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        tokens, sizes = np.concatenate(hashes), np.concatenate(counts)
        ids = pa.concat_arrays(ids)
        firsts = np.cumsum(sizes + _GAP) - sizes - _GAP
        position = np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(tokens))
        order = np.argsort(tokens, kind="stable")
        ranked = tokens[order]
        new = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, np.int64)
        wide = "<i8" if len(tokens) and position[-1] >= 2**31 else "<i4"
        parts = (
            ids.fill_null(0).to_numpy().astype("<i8"), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8),
            firsts.astype("<i8"), sizes.astype("<i8"), ranked[new].astype("<u8"), np.r_[new, len(ranked)].astype("<i8"),
            position[order].astype(wide),
        )
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (uuid.uuid4().bytes, *(x.tobytes() for x in parts))], schema=schema)

    @common.lean
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, counts, held = [], [], [], 0
        for whole in batches:
            for i, k in words.slices([whole["text"]], 1 << 20):
                h, n = words.hashed(whole["text"].slice(i, k - i), words.ALNUM)
                own, at, ends = whole["doc_id"].slice(i, k - i), 0, np.cumsum(n + _GAP)
                while at < len(n):
                    # as many documents as still fit, or one
                    done = int(ends[at - 1]) if at else 0
                    to = max(at + (not held), int(np.searchsorted(ends, done + segment_size - held, side="right")))
                    words_before = int(n[:at].sum())
                    ids.append(own.slice(at, to - at))
                    hashes.append(h[words_before : words_before + int(n[at:to].sum())])
                    counts.append(n[at:to])
                    held += int(ends[to - 1]) - done if to else 0
                    if to < len(n) or held >= segment_size:
                        yield segment(ids, hashes, counts)
                        ids, hashes, counts, held = [], [], [], 0
                    at = to
        if ids:
            yield segment(ids, hashes, counts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(segments, _SEGMENT)


class Segment:
    """Postings of one segment."""

    def __init__(self, row):
        self.ids, self.there = np.frombuffer(row.doc_ids, "<i8"), np.frombuffer(row.there, np.uint8).astype(bool)
        self.firsts, self.sizes = np.frombuffer(row.firsts, "<i8"), np.frombuffer(row.sizes, "<i8")
        self.terms, self.starts = np.frombuffer(row.terms, "<u8"), np.frombuffer(row.starts, "<i8")
        n, self.keys = int(self.starts[-1]), None
        self.positions = np.frombuffer(row.positions, "<i4" if len(row.positions) == 4 * n else "<i8")

    def lists(self, terms: np.ndarray) -> list[np.ndarray] | None:
        """The position lists of terms; None if one of them does not occur."""
        at = np.searchsorted(self.terms, terms)
        if (at == len(self.terms)).any() or (self.terms[at] != terms).any():
            return None
        return [self.positions[a:b] for a, b in zip(self.starts[at], self.starts[at + 1], strict=True)]

    def phrases(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of one length (rows of `terms`) occur: the phrase and the position of its first word."""
        none = np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        there = np.flatnonzero((self.terms[at] == terms).all(axis=1)) if len(self.terms) else none
        if not len(there):
            return none, none
        at = at[there]
        counts = self.starts[at + 1] - self.starts[at]
        order = np.argsort(counts, axis=1, kind="stable")
        at, least = np.take_along_axis(at, order, 1), np.take_along_axis(counts, order, 1)[:, 0]
        ends, found, i = np.cumsum(least), [(none, none)], 0
        if self.keys is None:
            self.keys = np.repeat(np.arange(len(self.terms), dtype=np.int64) << 40, np.diff(self.starts)) + self.positions
        while i < len(there):
            j = max(i + 1, int(np.searchsorted(ends, (int(ends[i - 1]) if i else 0) + FOLLOWED, side="right")))
            n = least[i:j]
            phrase = np.repeat(np.arange(i, j), n)
            place = self.positions[np.repeat(self.starts[at[i:j, 0]], n) + np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)]
            start = place.astype(np.int64) - order[phrase, 0]
            for r in range(1, terms.shape[1]):
                want = (at[phrase, r] << 40) + start + order[phrase, r]
                ok = (start >= 0) & (self.keys[np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)] == want)
                phrase, start = phrase[ok], start[ok]
            found.append((there[phrase], start))
            i = j
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term that has every other term within `slop` words of it."""
        found = self.lists(terms)
        if found is None:
            return np.empty(0, np.int64)
        found.sort(key=len)
        at = found[0].astype(np.int64)
        home = self.document(at)
        for other in found[1:]:
            # the nearest occurrences on both sides; only those in the same document count
            i = np.searchsorted(other, at)
            ok = np.zeros(len(at), bool)
            for j in (i - 1, i):
                k = np.clip(j, 0, len(other) - 1)
                there = other[k].astype(np.int64)
                ok |= (j >= 0) & (j < len(other)) & (np.abs(there - at) <= slop) & (self.document(there) == home)
            at, home = at[ok], home[ok]
        return at

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, positions, side="right") - 1


def windows(items: list[tuple], size: int = WINDOW) -> list[tuple[np.ndarray, list[set]]]:
    """Different windows of items (id, text), those of one length together: term hashes, and the ids that have each."""
    owners: dict[bytes, set] = {}
    for item_id, text in items:
        h = words.hashed(pa.array([text], pa.string()), words.ALNUM)[0]
        for i in range(max(1, len(h) - size + 1) if len(h) else 0):
            owners.setdefault(h[i : i + size].tobytes(), set()).add(item_id)
    out: dict[int, tuple[list, list]] = {}
    for key, ids in owners.items():
        terms, own = out.setdefault(len(key) // 8, ([], []))
        terms.append(np.frombuffer(key, np.uint64))
        own.append(ids)
    return [(np.array(terms), own) for terms, own in out.values()]


_HITS = "doc_id long, n_words long, n_hit long, items array<string>"


def _hits(seg: Segment, test: list[tuple[np.ndarray, list[set]]]) -> tuple[pd.DataFrame, np.ndarray]:
    """The documents of a segment with their hits, and the hit intervals of the segment."""
    marks = np.zeros(int(seg.firsts[-1] + seg.sizes[-1]) + 1, np.int32)
    listed: dict[int, set] = {}
    for terms, owners in test:
        phrase, at = seg.phrases(terms)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + terms.shape[1], -1)
        for p, d in set(zip(phrase.tolist(), seg.document(at).tolist(), strict=True)):
            listed.setdefault(d, set()).update(str(x) for x in owners[p] if x is not None)
    on = np.cumsum(marks[:-1], dtype=np.int32) > 0
    sums = np.r_[0, np.cumsum(on)]
    n_hit = sums[np.minimum(seg.firsts + seg.sizes, len(on))] - sums[np.minimum(seg.firsts, len(on))]
    out = pd.DataFrame({"doc_id": pd.array(seg.ids, "Int64"), "n_words": seg.sizes, "n_hit": n_hit})
    out.loc[~seg.there, "doc_id"] = pd.NA
    out["items"] = [sorted(listed.get(d, ())) for d in range(len(out))]
    return out, np.flatnonzero(np.diff(np.r_[0, on.astype(np.int8), 0])).reshape(-1, 2)


def _probe(index: DataFrame, items: list[tuple], size: int, keyed: bool) -> DataFrame:
    """_HITS of every document; keyed adds the segment, the row in it and the hit intervals."""

    @common.lean
    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        test = windows(items, size)
        for batch in batches:
            for row in batch.itertuples(index=False):
                seg = Segment(row)
                out, spans = _hits(seg, test)
                if keyed:
                    of: dict[int, list] = {}
                    for d, (begin, end) in zip(seg.document(spans[:, 0]).tolist(), spans.tolist(), strict=True):
                        of.setdefault(d, []).append({"begin": begin, "end": end})
                    out = out.assign(spans=[of.get(d, []) for d in range(len(out))], segment=row.uid, row=range(len(out)))
                yield out

    more = ", spans array<struct<begin: long, end: long>>, segment binary, row long"
    return index.mapInPandas(probe, _HITS + more * keyed)


def _blocks(bench: DataFrame, block: int) -> Iterator[list[tuple]]:
    """The items (id, text) of a test set in blocks of at most `block` words, or of one item."""
    out, held = [], 0
    for item in bench.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        n = len(words.hashed(pa.array([item["text"]], pa.string()), words.ALNUM)[0])
        if out and held + n > block:
            yield out
            out, held = [], 0
        out.append((item["item_id"], item["text"]))
        held += n
    yield out


_MATCH = "doc_id long, item_id string, begin long, end long"


def _places(index: DataFrame, bench: DataFrame, size: int, block: int, find) -> DataFrame:
    """_MATCH of what find(segment, terms) returns, as (phrase, begin, end) in positions of the segment."""

    def of(items: list[tuple]) -> DataFrame:
        @common.lean
        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            test = windows(items, size)
            for batch in batches:
                for row in batch.itertuples(index=False):
                    seg, out = Segment(row), []
                    for terms, owners in test:
                        for p, begin, end in zip(*(x.tolist() for x in find(seg, terms)), strict=True):
                            d = int(seg.document(np.array([begin]))[0])
                            first, doc_id = int(seg.firsts[d]), int(seg.ids[d]) if seg.there[d] else None
                            out += [(doc_id, None if x is None else str(x), begin - first, end - first) for x in owners[p]]
                    yield pd.DataFrame(out, columns=["doc_id", "item_id", "begin", "end"]).astype({"doc_id": "Int64", "begin": "int64", "end": "int64"})

        return index.mapInPandas(probe, _MATCH)

    found = None
    for items in _blocks(bench, block):
        found = of(items) if found is None else found.unionByName(of(items))
    return found


def matches(index: DataFrame, bench: DataFrame, size: int = WINDOW, block: int = PHRASES) -> DataFrame:
    """(doc_id, item_id, begin, end): the words of documents at which windows of the items stand."""

    def find(seg: Segment, terms: np.ndarray):
        phrase, at = seg.phrases(terms)
        return phrase, at, at + terms.shape[1]

    return _places(index, bench, size, block, find)


def proximity(index: DataFrame, bench: DataFrame, slop: int, size: int = WINDOW, block: int = PHRASES) -> DataFrame:
    """(doc_id, item_id, begin, end): the rarest word of a window that has all its others within `slop` words, in any order."""

    def find(seg: Segment, terms: np.ndarray):
        found = [seg.near(t, slop) for t in terms]
        at = np.concatenate([np.empty(0, np.int64), *found])
        return np.repeat(np.arange(len(terms)), [len(f) for f in found]), at, at + 1

    return _places(index, bench, size, block, find)


def search(index: DataFrame, bench: DataFrame, size: int = WINDOW, block: int = PHRASES) -> DataFrame:
    """Per indexed document: doc_id, n_words, n_hit, items (ids with occurring windows, as sorted strings).

    The test set is fetched once to be cut into blocks of at most `block` words; with more than
    one block, hit intervals of the blocks are merged by document.
    """
    blocks = list(_blocks(bench, block))
    if len(blocks) == 1:
        return _probe(index, blocks[0], size, False)
    union = _probe(index, blocks[0], size, True)
    for items in blocks[1:]:
        union = union.unionByName(_probe(index, items, size, True))
    # a document has as many rows as there are blocks
    merged = union.groupBy("segment", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    n_hit = F.aggregate(
        "spans", start,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["begin"], s["to"]))).alias("n"),
            F.greatest(s["to"], x["end"]).alias("to"),
        ),
        lambda s: s["n"],
    )
    return merged.select("doc_id", "n_words", n_hit.alias("n_hit"), "items")


def decontaminate(docs: DataFrame, bench: DataFrame, size: int = WINDOW) -> DataFrame:
    """Index the documents, search the test set, and return one row a document."""
    scratch = common.Scratch(docs.sparkSession, "index")
    index = scratch.keep(build(docs), "segments", compression="zstd")
    return search(index, bench, size)


def digest_items(items: F.Column) -> F.Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)

