"""Ranked lexical search by a block-max index with blocks of chosen lengths.

Terms are maximal runs of 0-9, a-z (A-Z lower-cased) and code points from U+0080. With N the documents that
have a term, L their terms, n those of one document, df the documents that hold a term and tf its places in
one, a document has m = 100 - 75 + (75 * n * N) div L, a place in a posting list the impact
(10^9 * tf) div (1000 * tf + 8 * m), a term the weight w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), and
a query scores the sum of w * impact over its terms, repeats included: integers throughout, so bounds are exact.

The index is a written table of shards, each of about SHARD words of whole documents: sorted hashes of
terms, and for each term ascending document numbers with impacts, in blocks. Where blocks end is chosen by
dynamic programming: a block costs BLOCK_COST and, for each of its postings, by how much the block's greatest
impact exceeds the posting's; the sum is least (of blocks of at most WIDEST postings; lists are cut every STRETCH
postings, so all lists of a shard are solved side by side).

`search` looks every item up in every shard. The ends of the blocks of an item's terms cut the shard's documents
into intervals, and the sum of the greatest impacts of the blocks over an interval bounds what its documents can
score. Intervals are taken by falling bound, some at a time, and only the blocks that reach into them are read;
once the bounds left are below the k-th best score, the rest is skipped. That score is carried from shard to
shard of a task. What a task returns is at most k rows an item, and a window over them gives the result.

Items are sent to the shards in blocks of at most ITEM_WORDS words, so what the driver and a task hold has a fixed
bound; each block reads the index twice, for the frequencies of its terms and for the search.

Edge cases: a null or empty text has no term, is not counted in N and never found; an item without terms,
or whose terms no document holds, has no rows; items with equal or null item_id are ranked each for itself;
rows with equal doc_id are separate documents, each ranked, and a null doc_id comes last among equals; a text of
any length is in one shard; other columns are not looked at; without documents, or without items, there are no rows.
Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, words

TOP = 10
#: Words after which a shard is closed; a longer document makes a shard of its own.
SHARD = 1_000_000
#: What a block costs, in units of impact, its most postings, and the postings that are cut into blocks together.
BLOCK_COST, WIDEST, STRETCH = 1_000_000, 64, 4096
#: Words of items sent to the shards at a time.
ITEM_WORDS = 500_000
_SHARD = "doc_ids binary, there binary, terms binary, starts binary, docs binary, impacts binary, ends binary"


def totals(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            c = words.counts(batch["text"], words.ALNUM)
            n, total = n + int((c > 0).sum()), total + int(c.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    row = docs.select("text").mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """What a term with tf places adds to the score of a document of n terms, by unit of the term's weight."""
    m = 25 + (75 * n_docs * n.astype(np.int64)) // max(n_words, 1)
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf + 8 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def block_ends(values: np.ndarray, starts: np.ndarray, cost: int = BLOCK_COST, widest: int = WIDEST, stretch: int = STRETCH) -> np.ndarray:
    """Where blocks of posting lists end, ascending; lists are values[starts[i]:starts[i + 1]].

    dp[j], the least cost of the first j postings, is the least over block lengths l of dp[j - l] + cost +
    l * greatest - sum; the sums are the same whatever the blocks, so they are left out.
    """
    size = np.diff(starts)
    n = -(-size // stretch)
    of = np.repeat(np.arange(len(size)), n)
    begin = starts[of] + stretch * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
    length = np.minimum(starts[of + 1] - begin, stretch)
    found = [begin[length == 1] + 1]
    for k in range(1, stretch.bit_length()):
        some = np.flatnonzero((length > 1 << (k - 1)) & (length <= 1 << k))
        # so many lists at a time that the table of choices stays small
        for part in np.array_split(some, -(-len(some) * (1 << k) // (1 << 22))) if len(some) else []:
            found.append(_solved(values, begin[part], length[part], cost, min(widest, 1 << k)))
    return np.sort(np.concatenate(found))


def _solved(values: np.ndarray, begin: np.ndarray, length: np.ndarray, cost: int, widest: int) -> np.ndarray:
    """The ends of the blocks of several stretches, all solved step by step."""
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    most, lists = int(length[0]), len(begin)
    live = np.searchsorted(-length, -np.arange(most), side="left")
    lengths = np.arange(1, widest + 1)
    never = np.iinfo(np.int64).max // 2
    # of each list: the least costs of the last `widest` beginnings, latest first, and the greatest impact since each
    least, top = np.full((lists, widest), never), np.zeros((lists, widest), np.int64)
    least[:, 0] = 0
    chosen = np.zeros((most, lists), np.uint8 if widest < 256 else np.int32)
    for j in range(most):
        m = int(live[j])
        x = values[begin[:m] + j].astype(np.int64)
        top[:m, 1:] = top[:m, :-1]
        top[:m, 0] = 0
        np.maximum(top[:m], x[:, None], out=top[:m])
        total = least[:m] + top[:m] * lengths
        best = total.argmin(axis=1)
        chosen[j, :m] = best
        least[:m, 1:] = least[:m, :-1]
        least[:m, 0] = total[np.arange(m), best] + cost
    # back from the last posting of each list
    ends, at, rest = [], length.copy(), np.arange(lists)
    while len(rest):
        ends.append(begin[rest] + at[rest])
        at[rest] -= chosen[at[rest] - 1, rest].astype(np.int64) + 1
        rest = rest[at[rest] > 0]
    return np.concatenate(ends)


def build(docs: DataFrame, n_docs: int, n_words: int, size: int = SHARD) -> DataFrame:
    """The shards of an index over (doc_id, text) with the given totals; write them before use."""
    schema = pa.schema([(x.split()[0], pa.binary()) for x in _SHARD.split(", ")])

    def shard(ids: list[pa.Array], hashes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        tokens, n = np.concatenate(hashes), np.concatenate(counts)
        ids = pa.concat_arrays(ids)
        of = np.repeat(np.arange(len(n), dtype=np.int32), n)
        order = np.argsort(tokens, kind="stable")
        tokens, of = tokens[order], of[order]
        first = np.ones(len(tokens), bool)
        first[1:] = (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])
        head = np.flatnonzero(first)
        tf = np.diff(np.r_[head, len(tokens)])
        tokens, of = tokens[head], of[head]
        new = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, np.int64)
        starts = np.r_[new, len(tokens)].astype(np.int64)
        value = impacts(tf, n[of], n_docs, n_words)
        parts = (
            ids.fill_null(0).to_numpy().astype("<i8"), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8),
            tokens[new].astype("<u8"), starts.astype("<i4"), of.astype("<i4"), value.astype("<i4"), block_ends(value, starts).astype("<i4"),
        )
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], schema=schema)

    @common.lean
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, counts, held = [], [], [], 0
        for whole in batches:
            for i, k in words.slices([whole["text"]], 1 << 20):
                h, n = words.hashed(whole["text"].slice(i, k - i), words.ALNUM)
                own, at, ends = whole["doc_id"].slice(i, k - i), 0, np.cumsum(n + 1)
                while at < len(n):  # as many documents as still fit, or one
                    done = int(ends[at - 1]) if at else 0
                    to = max(at + (not held), int(np.searchsorted(ends, done + size - held, side="right")))
                    before = done - at
                    ids.append(own.slice(at, to - at))
                    hashes.append(h[before : before + int(n[at:to].sum())])
                    counts.append(n[at:to])
                    held += int(ends[to - 1]) - done if to else 0
                    if to < len(n) or held >= size:
                        yield shard(ids, hashes, counts)
                        ids, hashes, counts, held = [], [], [], 0
                    at = to
        if ids:
            yield shard(ids, hashes, counts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(shards, _SHARD)


class Shard:
    """One shard, opened."""

    def __init__(self, row):
        self.ids, self.there = np.frombuffer(row.doc_ids, "<i8"), np.frombuffer(row.there, np.uint8).astype(bool)
        self.terms, self.starts = np.frombuffer(row.terms, "<u8"), np.frombuffer(row.starts, "<i4")
        self.docs, self.impacts = np.frombuffer(row.docs, "<i4"), np.frombuffer(row.impacts, "<i4")
        self.begin = np.r_[0, np.frombuffer(row.ends, "<i4")].astype(np.int64)  # of blocks
        self.top = np.maximum.reduceat(self.impacts, self.begin[:-1]).astype(np.int64) if len(self.impacts) else np.empty(0, np.int64)
        self.block = np.searchsorted(self.begin, self.starts)  # the first block of each term

    def scores(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Hand every document that may be among the best to `best`, with its whole score."""
        at = np.searchsorted(self.terms, terms)
        there = np.flatnonzero(at < len(self.terms))
        there = there[self.terms[at[there]] == terms[there]]
        at, weights = at[there], weights[there]
        n = self.block[at + 1] - self.block[at]
        if not len(n):
            return
        block = np.repeat(self.block[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        w = np.repeat(weights, n)
        bound = w * self.top[block]
        edges, place = np.unique(np.concatenate([self.docs[self.begin[block]], self.docs[self.begin[block + 1] - 1] + 1]), return_inverse=True)
        low, high = place[: len(block)], place[len(block) :]
        change = np.zeros(len(edges), np.int64)
        np.add.at(change, low, bound)
        np.add.at(change, high, -bound)
        upper = np.cumsum(change)
        order, done, take = np.argsort(-upper, kind="stable"), 0, 16
        while done < len(order):
            now = order[done : done + take]
            now = now[upper[now] >= best.least]
            if not len(now):
                return
            chosen = np.zeros(len(edges), bool)
            chosen[now] = True
            sums = np.r_[0, np.cumsum(chosen)]
            read = np.flatnonzero(sums[high] > sums[low])
            size = self.begin[block[read] + 1] - self.begin[block[read]]
            posting = np.repeat(self.begin[block[read]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            doc, score = self.docs[posting], self.impacts[posting] * np.repeat(w[read], size)
            inside = chosen[np.searchsorted(edges, doc, side="right") - 1]
            doc, score = doc[inside], score[inside]
            order_ = np.argsort(doc, kind="stable")
            doc, score = doc[order_], score[order_]
            head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
            if len(head):
                doc = doc[head]
                best.add(np.add.reduceat(score, head), self.ids[doc], self.there[doc])
            done, take = done + take, 4 * take


class Best:
    """The k best documents so far, by score, then by doc_id."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.ids, self.there = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, there: np.ndarray) -> None:
        some = score >= self.least
        score, ids, there = (np.concatenate([a, b[some]]) for a, b in ((self.score, score), (self.ids, ids), (self.there, there)))
        order = np.lexsort((ids, ~there, -score))[: self.k]
        self.score, self.ids, self.there = score[order], ids[order], there[order]
        if len(order) == self.k:
            self.least = max(1, int(self.score[-1]))


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    """(item_id, terms, repeats) of items with terms, in blocks of at most `size` words, or of one item."""
    out, held = [], 0
    for item in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        h = words.hashed(pa.array([item["text"]], pa.string()), words.ALNUM)[0]
        if not len(h):
            continue
        if out and held + len(h) > size:
            yield out
            out, held = [], 0
        out.append((item["item_id"], *np.unique(h, return_counts=True)))
        held += len(h)
    if out:
        yield out


def frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """The documents that hold each of some terms (sorted), as far as any does."""

    @common.lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, starts in zip(batch["terms"], batch["starts"], strict=True):
                own, starts = np.frombuffer(own, "<u8"), np.frombuffer(starts, "<i4")
                at = np.searchsorted(own, terms)
                some = np.flatnonzero(at < len(own))
                some = some[own[at[some]] == terms[some]]
                found[some] += starts[at[some] + 1] - starts[at[some]]
        some = np.flatnonzero(found)
        yield pd.DataFrame({"term": some, "df": found[some]})

    sums = index.select("terms", "starts").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {int(terms[r["term"]]): r["df"] for r in sums.toLocalIterator()}


_FOUND = "item long, score long, doc_id long"


def search(index: DataFrame, items: DataFrame, n_docs: int, k: int = TOP, block: int = ITEM_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    found = None
    for part in _blocks(items, block):
        terms = np.unique(np.concatenate([t for _, t, _ in part]))
        df = frequencies(index, terms)
        weights = np.array([weight(df[t], n_docs) if t in df else 0 for t in terms.tolist()], np.int64)
        asked = []
        for _, own, repeats in part:
            w = weights[np.searchsorted(terms, own)] * repeats
            asked.append((own[w > 0], w[w > 0]))

        @common.lean
        def run(batches: Iterator[pd.DataFrame], asked=asked) -> Iterator[pd.DataFrame]:
            best = [Best(k) for _ in asked]
            for batch in batches:
                for row in batch.itertuples(index=False):
                    shard = Shard(row)
                    for (own, w), b in zip(asked, best, strict=True):
                        shard.scores(own, w, b)
            for i, b in enumerate(best):
                if len(b.score):
                    ids = pd.array(b.ids, "Int64")
                    ids[~b.there] = pd.NA
                    yield pd.DataFrame({"item": i, "score": b.score, "doc_id": ids})

        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = index.mapInPandas(run, _FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        # one row an item of the block
        names = index.sparkSession.createDataFrame([(i, x) for i, (x, _, _) in enumerate(part)], "item long, item_id " + dict(items.dtypes)["item_id"])
        rows = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return items.sparkSession.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long")
    return found


def best_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Index the documents and rank them for each item: item_id, rank, doc_id, score."""
    scratch = common.Scratch(docs.sparkSession, "ranked")
    n_docs, n_words = totals(docs)
    index = scratch.keep(build(docs, n_docs, n_words), "shards", compression="zstd")
    return search(index, items, n_docs, k)
