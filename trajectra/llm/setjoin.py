"""N-gram Jaccard join by a partition of the universe and the pigeonhole principle.

Two sets of sizes r <= s with Jaccard similarity 0.8 or more differ in at most H = (r + s) / 9
shingles, and s <= 1.25 r. The universe of shingles is hashed to segments, more of them for larger
sets: a size band j serves all pairs whose smaller set has a size in [L_j, L_j+1), so a set takes
part in its own band and, as the larger one, in the one or two below it.

Signatures of a set in a band, by the allocation that costs least for the band's population:

* exact: the contents of its first H + 1 segments that are not empty. At most H segments differ,
  and identical empty ones are as few as the set has skipped, so two similar sets share one, unless
  both ran out of segments.
* one deletion: its first H / 2 + 1 (larger) segments, each whole and without each of its
  shingles. Some segment differs by one shingle at most, which one of those contents bridges.

A set that runs out of segments gives all it has and goes on to the next of four levels, each with a
partition of its own, where it meets the only sets that it could have missed: those that ran out, too.
The first two levels leave out shingles that many documents of a bounded sample have. Sets differ by
H of the other shingles at most, too, so nothing is missed whatever the sample holds, and documents
that have no more than a common passage in common do not meet. The third level has all shingles; the
last takes H + 1 segments as they are, empty or not, and no set runs out of them.

Signatures travel as packed blocks by bucket and meet there; every candidate is verified on the sets
themselves. A task holds HOLD signatures of a bucket at most, and then goes on with the least set of
each, which stands for those before.

Not all pairs of a group are looked at. Texts that are equal are one node. Each node is verified
first with the least node it shares most signatures with, and components are formed. Nodes that share
a signature but fall into different components are compared by parity sketches, whose difference
is never larger than that of the sets: for ROUNDS rounds each such node is verified with its likeliest
partner, which joins most of what belongs together; then every pair across components that
sketches can't tell apart is verified. So no link between different components is missed. Groups of
more than GROUP open nodes are dealt to tasks in blocks of parts against parts.

Shingles and texts are told apart by 64-bit hashes.

Edge cases: a text without words (null, empty, white space) has no shingles and links with nothing;
fewer than five words make one shingle; equal texts are one component; rows that repeat a doc_id
are separate documents; a null doc_id is no component id unless all its component's are null; texts
of any length are hashed a tile at a time; other columns are not looked at, whatever their names; an
empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pairs, words
from .common import Scratch
from .components import components

WORDS = 5
#: Signatures that a task packs at a time, that it holds of a bucket, and that a bucket has on average.
PACK, HOLD, BUCKET = 400_000, 1_000_000, 500_000
#: Buckets of the exchange at most; beyond, a task deals what it gets to finer ones.
BUCKETS = 8_192
#: Open nodes of a group that one task compares with one another, or with as many others.
GROUP = 4_096
#: Rounds in which each open node is verified with one partner only, before all open pairs are.
ROUNDS = 3
#: Of two sets that are not similar, the share of pairs with a common passage and its share of a set;
#: the cost of comparing two sketches, in signatures. They choose an allocation, never a result.
SHARING, OVERLAP, COMPARE = 0.01, 0.25, 0.05
#: Texts in the sample for common shingles, the share of them that makes one common, and how many of
#: these are used at most. They make groups smaller, and never change a result.
SAMPLE, COMMON, USED = 4_000, 0.01, 200_000
#: Nodes that a task remembers to have seen, so that it signs copies once.
SEEN = 100_000


def token_sets(texts: pa.Array, k: int = WORDS, inside: np.ndarray = words.BLANK) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of k-word shingles of all texts, one after the other, and their sizes.

    With fewer words, the whole sequence is one shingle.
    """
    h, counts = words.hashed(texts, inside)
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    found, owner = [], []
    for n in range(1, k + 1):
        if n < k and not (counts == n).any():
            continue
        g = common.grams(h, n)
        at = np.arange(len(g))
        fits = at + n <= ends[row[: len(g)]]
        # texts with fewer than k words have one shingle, of all of their words
        fits &= counts[row[: len(g)]] >= k if n == k else counts[row[: len(g)]] == n
        found.append(g[fits])
        owner.append(row[: len(g)][fits])
    tokens, owner = np.concatenate(found), np.concatenate(owner)
    if len(found) > 1:
        order = np.argsort(owner, kind="stable")
        tokens, owner = tokens[order], owner[order]
    at = np.flatnonzero(np.r_[np.ones(min(len(owner), 1), bool), owner[1:] != owner[:-1]]).tolist()
    for a, b in zip(at, [*at[1:], len(owner)], strict=False):
        tokens[a:b].sort()
    new = np.r_[np.ones(min(len(tokens), 1), bool), (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])]
    return tokens[new], np.bincount(owner[new], minlength=len(counts))


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """The sorted set of one text."""
    return token_sets(pa.array([text], pa.string()), k)[0]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 80 * union, for sorted sets that are not empty."""
    if 100 * min(len(a), len(b)) < 80 * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= 80 * (len(a) + len(b) - both)


@lru_cache(maxsize=1)
def bands() -> np.ndarray:
    """The least size of each band, up to 2**40."""
    out = [1]
    while out[-1] < 2**40:
        out.append(max(out[-1] + 1, -(-out[-1] * 5 // 4)))
    return np.array(out)


def most(j: int) -> int:
    """The largest size that takes part in band j."""
    return 5 * (int(bands()[j + 1]) - 1) // 4


def bands_of(size: int) -> list[int]:
    """The bands that a set of this size takes part in, its own first."""
    j = int(np.searchsorted(bands(), size, side="right")) - 1
    out = [j]
    while j > 0 and size <= most(j - 1):
        j -= 1
        out.append(j)
    return out


def differences(size: int, j: int) -> int:
    """The most shingles in which a set of this size and a similar one differ in band j."""
    first, end = int(bands()[j]), int(bands()[j + 1]) - 1
    partner = min(5 * size // 4, most(j)) if first <= size <= end else end
    return (size + partner) // 9


def reach(j: int) -> int:
    """The most differences of any two similar sets in a band."""
    return max(differences(int(bands()[j + 1]) - 1, j), differences(most(j), j))


@lru_cache(maxsize=4096)
def allocation(j: int, population: int) -> tuple[bool, int]:
    """(one deletion?, segments) of a band, by estimated cost."""
    end, h = int(bands()[j + 1]) - 1, reach(j)
    exact, loose = (h + 1) * 6 // 5, (h // 2 + 1) * 6 // 5
    per, per_loose = end / exact, end / loose
    pairs_of = population**2 / 2 * SHARING * COMPARE
    cost = (h + 1) * population + pairs_of * (h + 1) * OVERLAP**per
    cost_loose = loose * (1 + per_loose) * population + pairs_of * loose * per_loose * OVERLAP ** (per_loose - 1)
    return (True, loose) if h > 1 and cost_loose < cost else (False, exact)


def _segments(tokens: np.ndarray, sizes: np.ndarray, salt: int, m: int):
    """Tokens by set and segment: the order, where each segment begins in it, its set and its place."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    where = ((common.mix(tokens + np.uint64(salt)) >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(owner * m + where, kind="stable")
    where, owner = where[order], owner[order]
    starts = np.flatnonzero(np.r_[np.ones(min(len(where), 1), bool), (where[1:] != where[:-1]) | (owner[1:] != owner[:-1])])
    return order, starts, owner[starts], where[starts]


def _until_enough(tokens: np.ndarray, sizes: np.ndarray, need: np.ndarray, salt: int, m: int, loose: bool):
    """Signatures of each set's segments up to the one that makes `need`; whose each is; the sets that ran out.

    With one deletion, only segments of two shingles or more count: without one of them they are not empty.
    """
    order, starts, own, at = _segments(tokens, sizes, salt, m)
    if not len(starts):
        return np.empty(0, np.uint64), own, np.ones(len(sizes), bool)
    inner, length = tokens[order], np.diff(np.r_[starts, len(tokens)])
    counts = (length > loose).astype(np.int64)
    total = np.bincount(own, counts, len(sizes)).astype(np.int64)
    before = np.cumsum(counts) - counts
    first = np.searchsorted(own, own)
    taken = before - before[first] < need[own]
    sums = np.add.reduceat(inner, starts)
    tag = common.mix(at.astype(np.uint64) + (np.uint64(salt) << np.uint64(24)))
    sigs, owners = common.mix(sums[taken] + tag[taken]), own[taken]
    if loose:
        slot = np.repeat(np.arange(len(starts)), length)
        cut = taken[slot] & (length[slot] > 1)
        sigs = np.concatenate([sigs, common.mix(sums[slot[cut]] - inner[cut] + tag[slot[cut]])])
        owners = np.concatenate([owners, own[slot[cut]]])
    return sigs, owners, total < need


def _as_they_are(tokens: np.ndarray, sizes: np.ndarray, take: np.ndarray, salt: int, m: int):
    """Signatures of each set's first `take` segments, empty ones, too; whose each is."""
    order, starts, own, at = _segments(tokens, sizes, salt, m)
    base = np.cumsum(take) - take
    holder = np.repeat(np.arange(len(sizes)), take)
    whole = np.zeros(len(holder), np.uint64)
    low = at < take[own]
    whole[base[own[low]] + at[low]] = np.add.reduceat(tokens[order], starts)[low]
    tag = common.mix((np.arange(len(whole)) - base[holder]).astype(np.uint64) + (np.uint64(salt) << np.uint64(24)))
    return common.mix(whole + tag), holder


def signatures(tokens: np.ndarray, sizes: np.ndarray, population: dict[int, int], ordinary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit signatures of sets (one after the other, none empty) in all their bands, and which set has each.

    `ordinary` are the sorted common shingles that the first two levels leave out.
    """
    sigs, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    rare = np.ones(len(tokens), bool)
    if ordinary is not None and len(ordinary):
        rare = ordinary[np.minimum(np.searchsorted(ordinary, tokens), len(ordinary) - 1)] != tokens
    starts = np.cumsum(sizes) - sizes
    members: dict[int, list[int]] = {}
    for i, size in enumerate(sizes.tolist()):
        for j in bands_of(size):
            members.setdefault(j, []).append(i)
    for j, inside in members.items():
        rows = np.array(inside)
        loose, m = allocation(j, population.get(j, 1))
        h = np.array([differences(int(sizes[i]), j) for i in inside])
        for level, parts in enumerate((m, 4 * m, m, reach(j) + 1)):
            n = sizes[rows]
            at = np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            salt = (level << 16) + j + 1
            if level == 3:
                s, o = _as_they_are(tokens[at], n, h + 1, salt, parts)
                out = np.zeros(len(rows), bool)
            else:
                if level < 2:
                    kept = rare[at]
                    n = np.bincount(np.repeat(np.arange(len(rows)), n)[kept], minlength=len(rows))
                    at = at[kept]
                s, o, out = _until_enough(tokens[at], n, h // 2 + 1 if loose else h + 1, salt, parts, loose)
            sigs.append(s)
            owners.append(rows[o])
            if not out.any():
                break
            rows, h = rows[out], h[out]
    return np.concatenate(sigs), np.concatenate(owners)


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the shingles in each of 2**k >= 2 * size places, 64 at least."""
    bits = max(64, 2 << (len(tokens) - 1).bit_length())
    at = (tokens & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(rows: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the shortest."""
    least = min(map(len, rows))
    out = np.empty((len(rows), least // 8), np.uint64)
    for i, raw in enumerate(rows):
        x = np.frombuffer(raw, np.uint64)
        while len(x) > least // 8:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


_ROW = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("bucket", pa.int32()), ("payload", pa.binary())])
_ROW_SQL = "doc_id long, node long, n long, sketch binary, bucket int, payload binary"


def bucket_of(sig: np.ndarray, buckets: int) -> np.ndarray:
    return ((sig >> np.uint64(44)) % np.uint64(buckets)).astype(np.int64)


def pack(sig: np.ndarray, node: np.ndarray, bucket: np.ndarray, place: np.ndarray) -> list[tuple[int, bytes]]:
    """Signatures by bucket: 40 bits each and their places, if any, the nodes they are of, and how many each node has."""
    order = np.lexsort((node, bucket))
    bucket, sig, node, place = bucket[order], sig[order], node[order], place[order] if len(place) else place
    out = []
    starts = np.flatnonzero(np.r_[np.ones(min(len(sig), 1), bool), bucket[1:] != bucket[:-1]])
    low, high = (sig & np.uint64(0xFFFFFFFF)).astype("<u4"), ((sig >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(sig)], strict=True):
        first = np.flatnonzero(np.r_[True, node[a + 1 : b] != node[a : b - 1]])
        counts = np.diff(np.r_[first, b - a]).astype("<u4")
        own = place[a:b].astype("<u2")
        head = np.array([b - a, len(first), len(own)], "<u4")
        out.append((int(bucket[a]), b"".join(x.tobytes() for x in (head, low[a:b], high[a:b], own, node[a:b][first].astype("<i8"), counts))))
    return out


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, owners, placed = (int(x) for x in np.frombuffer(payload, "<u4", 3))
    sig = np.frombuffer(payload, "<u4", n, 12).astype(np.uint64)
    sig |= np.frombuffer(payload, np.uint8, n, 12 + 4 * n).astype(np.uint64) << np.uint64(32)
    place, at = np.frombuffer(payload, "<u2", placed, 12 + 5 * n), 12 + 5 * n + 2 * placed
    return sig, np.repeat(np.frombuffer(payload[at : at + 8 * owners], "<i8"), np.frombuffer(payload[at + 8 * owners :], "<u4")), place


class Packer:
    """Collects signatures of nodes and packs them, PACK at a time, by the bucket that `bucket` gives them."""

    def __init__(self, bucket, schema: pa.Schema, packed=pack):
        self.bucket, self.schema, self.packed, self.held, self.n = bucket, schema, packed, [], 0

    def add(self, sig: np.ndarray, node: np.ndarray, place: np.ndarray = np.empty(0, np.uint16)) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(sig), PACK):
            self.held.append((sig[i : i + PACK], node[i : i + PACK], place[i : i + PACK]))
            self.n += len(self.held[-1][0])
            if self.n >= PACK:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            sig, node, place = (np.concatenate([h[i] for h in self.held]) for i in range(3))
            self.held, self.n = [], 0
            blocks = self.packed(sig, node, self.bucket(sig), place)
            cols = {"bucket": pa.array([b for b, _ in blocks], pa.int32()), "payload": pa.array([p for _, p in blocks], pa.binary())}
            yield pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(len(blocks), f.type)) for f in self.schema], schema=self.schema)


def unseen(nodes: np.ndarray, seen: set) -> np.ndarray:
    """Which rows are the first of their node in this task, as far as it remembers (SEEN nodes)."""
    out = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes.tolist()):
        if node not in seen:
            out[i] = True
            if len(seen) < SEEN:
                seen.add(node)
    return out


def describe(docs: DataFrame, buckets: int, population: dict[int, int], ordinary: np.ndarray | None = None) -> DataFrame:
    """Rows of two kinds: one a document (doc_id, node, n, and a sketch once a node and task), and packed signatures (bucket, payload)."""

    @common.lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(lambda sig: bucket_of(sig, buckets), _ROW), set()
        for whole in batches:
            for i, k in words.slices([whole["text"]]):
                batch = whole.slice(i, k - i)
                node = batch["node"].to_numpy()
                tokens, sizes = token_sets(batch["text"])
                new = unseen(node, seen) & (sizes > 0)
                starts = np.cumsum(sizes) - sizes
                sketches = [sketch(tokens[a : a + n]) if f else None for a, n, f in zip(starts.tolist(), sizes.tolist(), new.tolist(), strict=True)]
                empty = lambda t, n=len(node): pa.nulls(n, t)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["node"], pa.array(sizes), pa.array(sketches, pa.binary()), empty(pa.int32()), empty(pa.binary())], schema=_ROW
                )
                sig, owner = signatures(tokens[np.repeat(new, sizes)], sizes[new], population, ordinary)
                yield from packer.add(sig, node[new][owner])
        yield from packer.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "node", "text").mapInArrow(rows, _ROW_SQL)


def common_shingles(docs: DataFrame, rows: int) -> np.ndarray:
    """The shingles that many of at most about SAMPLE different texts have: USED of them at most, sorted."""
    every = max(1, rows // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).groupBy("node").agg(F.first("text").alias("text"))

    @common.lean
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, k in words.slices([whole["text"]]):
                found = token_sets(whole["text"].slice(i, k - i))[0]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["token"])

    counts = some.mapInArrow(tokens, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") > max(2, int(COMMON * min(SAMPLE, rows)))).orderBy(F.desc("n"), "token").limit(USED)
    return np.sort(np.array([r["token"] for r in top.collect()], np.int64).view(np.uint64))


_BLOCK = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
_MEET = pa.schema([("node", pa.int64()), ("pivot", pa.int64()), ("shared", pa.int64()), ("grp", pa.int64())])


class _Bucket:
    """The signatures of a bucket: what shares one is linked with the least node that has it.

    Beyond HOLD signatures, those held are linked and only the least node of each stays.
    """

    SQL = "node long, pivot long, shared long, grp long"
    #: How blocks are packed and opened.
    packed, opened = staticmethod(pack), staticmethod(_unpack)

    def __init__(self):
        self.held, self.n, self.before = [], 0, None

    def add(self, payload: bytes) -> Iterator[pa.RecordBatch]:
        self.held.append(payload)
        self.n += int.from_bytes(payload[:4], "little")
        if self.n >= HOLD:
            yield from self.linked(False)

    def _sorted(self, last: bool) -> tuple[np.ndarray, ...]:
        """What is held by signature and node, each once: signature, node, whether a row was made of it, place."""
        parts = [self.opened(p) for p in self.held]
        parts = [(s, n, np.zeros(len(s), bool), p if len(p) else np.zeros(len(s), np.uint16)) for s, n, p in parts] + ([self.before] if self.before else [])
        self.held, self.n = [], 0
        sig, node, out, place = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((~out, node, sig))
        sig, node, out, place = sig[order], node[order], out[order], place[order]
        new = np.r_[np.ones(min(len(sig), 1), bool), (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
        return sig[new], node[new], out[new], place[new]

    def linked(self, last: bool = True) -> Iterator[pa.RecordBatch]:
        whole = last and not self.before
        sig, node, out, place = self._sorted(last)
        if not len(sig):
            return
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        size = np.diff(np.r_[starts, len(sig)])
        if not last:
            self.before = sig[starts], node[starts], np.logical_or.reduceat(out, starts) | (size > 1), place[starts]
        yield from self.rows(sig, node, out, place, starts, size, whole)

    def rows(self, sig, node, out, place, starts, size, whole: bool) -> Iterator[pa.RecordBatch]:
        """Links (node, pivot, shared), and the members (node, grp) of each different group."""
        many = np.repeat(size > 1, size)
        pivot = np.repeat(node[starts], size)
        other = many & (node != pivot)
        yield _counted(node[other], pivot[other])
        if not whole:
            inside = many & ~out
            yield _met(node[inside], None, None, common.mix(sig[inside]).view(np.int64))
        elif many.any():  # groups of the same nodes are one
            node, size = node[many], size[size > 1]
            key = np.add.reduceat(common.mix(node.view(np.uint64)), np.cumsum(size) - size)
            chosen = np.zeros(len(size), bool)
            chosen[np.unique(key, return_index=True)[1]] = True
            inside = np.repeat(chosen, size)
            yield _met(node[inside], None, None, np.repeat(key, size)[inside].view(np.int64))


def _counted(node: np.ndarray, pivot: np.ndarray) -> pa.RecordBatch:
    """Each different link once, and how often it was there."""
    order = np.lexsort((pivot, node))
    node, pivot = node[order], pivot[order]
    first = np.flatnonzero(np.r_[np.ones(min(len(order), 1), bool), (node[1:] != node[:-1]) | (pivot[1:] != pivot[:-1])])
    return _met(node[first], pivot[first], np.diff(np.r_[first, len(order)]), None)


def _met(node: np.ndarray, pivot: np.ndarray | None, shared: np.ndarray | None, grp: np.ndarray | None) -> pa.RecordBatch:
    cols = [pa.nulls(len(node), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (node, pivot, shared, grp)]
    return pa.RecordBatch.from_arrays(cols, schema=_MEET)


def meet(blocks: DataFrame, buckets: int, kind: type[_Bucket] = _Bucket) -> DataFrame:
    """What shares signatures (bucket, payload), as a bucket of this kind says."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, None
        for batch in batches:
            for b, payload in zip(batch["bucket"].to_pylist(), batch["payload"], strict=True):
                if b != bucket:
                    if held:
                        yield from held.linked()
                    bucket, held = b, kind()
                yield from held.add(payload.as_buffer().to_pybytes())
        if held:
            yield from held.linked()

    if buckets <= BUCKETS:
        tasks = min(buckets, max(common.partitions(blocks.sparkSession), buckets // 4))
        return blocks.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, kind.SQL)
    fine = -(-buckets // BUCKETS)

    @common.lean
    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = 0
        packer = Packer(lambda sig: current * fine + (sig % np.uint64(fine)).astype(np.int64), _BLOCK, kind.packed)
        for batch in batches:
            for b, payload in zip(batch["bucket"].to_pylist(), batch["payload"], strict=True):
                if b != current:
                    yield from packer.rest()
                    current = b
                yield from packer.add(*kind.opened(payload.as_buffer().to_pybytes()))
        yield from packer.rest()

    dealt = blocks.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket").mapInArrow(finer, "bucket int, payload binary")
    return dealt.sortWithinPartitions("bucket").mapInArrow(run, kind.SQL)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verify(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidates (a, b) whose sets are similar."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, k in words.slices([whole["ta"], whole["tb"]]):
                batch = whole.slice(i, k - i)
                a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
                # each different text once
                nodes, at = np.unique(np.r_[a, b], return_index=True)
                both = pa.concat_arrays([batch["ta"], batch["tb"]])
                tokens, sizes = token_sets(both.take(pa.array(at)))
                ends = np.cumsum(sizes)
                of = [tokens[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                ok = [similar(of[x], of[y]) for x, y in zip(np.searchsorted(nodes, a), np.searchsorted(nodes, b), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.with_texts(candidates.select("a", "b"), texts).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _slack(n: np.ndarray, sk: np.ndarray, n2: np.ndarray, sk2: np.ndarray) -> np.ndarray:
    """By how much, in ninths, sketches differ less than sets may; below 0 where sizes or sketches tell them apart."""
    far = np.bitwise_count(sk[:, None, :] ^ sk2[None, :, :]).sum(axis=2, dtype=np.int64)
    small, large = np.minimum(n[:, None], n2), np.maximum(n[:, None], n2)
    return np.where(5 * small >= 4 * large, n[:, None] + n2 - 9 * far, -1)


def _blocks(members: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Members (grp, ...) with the block (lo, hi) that they are compared in, and which of both sides they are on.

    A group of more than GROUP nodes is cut into parts, and each two parts, and each alone, make a block.
    """
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP)
    large = scratch.keep(sizes.select("grp", F.ceil(F.col("_n") / GROUP).cast("int").alias("_k")), name)
    zero = F.lit(0)
    small = members.join(large, "grp", "left_anti").select("*", zero.alias("lo"), zero.alias("hi"), zero.alias("side"))
    part = F.pmod(F.xxhash64("node"), F.col("_k")).cast("int")
    split = members.join(large, "grp").withColumn("side", part).withColumn("_o", F.explode(F.sequence(zero, F.col("_k") - 1)))
    split = split.select(*members.columns, F.least("side", "_o").alias("lo"), F.greatest("side", "_o").alias("hi"), "side")
    return small.unionByName(split)


def across(members: DataFrame, one: bool, scratch: Scratch, name: str) -> DataFrame:
    """Candidates (a, b, slack) of different components within groups (grp, node, comp, n, sketch).

    With `one`, only the likeliest partner of each node outside its group's largest component.
    """

    def compare(node: np.ndarray, comp: np.ndarray, n: np.ndarray, side: np.ndarray, sketches: list[bytes]) -> Iterator[tuple]:
        values, back, counts = np.unique(comp, return_inverse=True, return_counts=True)
        if len(values) < 2:
            return
        sk, cross = _folded(sketches), side.min() != side.max()
        # of any two components, one is not the largest
        rows = np.flatnonzero(back != counts.argmax())
        step = max(1, 500_000 // (len(node) * sk.shape[1]))
        for i in range(0, len(rows), step):
            r = rows[i : i + step]
            apart = comp[r][:, None] != comp
            if cross:
                apart &= side[r][:, None] != side
            slack = np.where(apart, _slack(n[r], sk[r], n, sk), -1)
            if one:
                x, y = np.arange(len(r)), slack.argmax(axis=1)
                x, y = x[slack[x, y] >= 0], y[slack[x, y] >= 0]
            else:
                x, y = np.nonzero(slack >= 0)
            a, b = node[r[x]], node[y]
            yield np.maximum(a, b), np.minimum(a, b), slack[x, y]

    def settled(found: list[tuple]) -> list[np.ndarray]:
        a, b, slack = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((b, -slack, a))
        a, b, slack = a[order], b[order], slack[order]
        new = np.r_[np.ones(min(len(a), 1), bool), (a[1:] != a[:-1]) | ((b[1:] != b[:-1]) if not one else False)]
        return [a[new], b[new], slack[new]]

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found, count = None, [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in settled(found)], names=["a", "b", "slack"])

        def group() -> None:
            nonlocal count
            if held:
                cols = [np.concatenate([h[i] for h in held]) for i in range(4)]
                for part in compare(*cols, [x for h in held for x in h[4]]):
                    found.append(part)
                    count += len(part[0])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy() for c in ("grp", "lo", "hi")], axis=1)
            cols = [batch[c].to_numpy() for c in ("node", "comp", "n", "side")]
            sketches = batch["sketch"].to_pylist()
            first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]).tolist()
            for i, k in zip(first, [*first[1:], len(keys)], strict=True):
                if tuple(keys[i]) != at:
                    group()
                    held, at = [], tuple(keys[i])
                    if count > 500_000:
                        yield from out()
                        found, count = [], 0
                held.append((*[c[i:k] for c in cols], sketches[i:k]))
        group()
        yield from out()

    keys = ["grp", "lo", "hi"]
    dealt = _blocks(members, scratch, name).select(*keys, "node", "comp", "n", "side", "sketch")
    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, slack long")
    pair = found.groupBy("a", "b").agg(F.max("slack").alias("slack"))
    if not one:
        return pair
    return pair.groupBy("a").agg(F.max_by("b", F.struct("slack", -F.col("b"))).alias("b"), F.max("slack").alias("slack"))


def populations(docs: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Rows, about how many signatures they have, and about how many sets each band has, from the lengths of the texts."""
    chars = F.coalesce(F.length("text"), F.lit(0))
    rows = (
        docs.groupBy(F.floor(F.log(chars / 6 + 1) / F.log(F.lit(1.25))).alias("k"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("c")).collect()  # fewer rows than 1.25 ** k fits a text's length
    )
    out: dict[int, int] = {}
    for r in rows:
        for j in bands_of(max(1, int(1.25 ** r["k"]))):
            out[j] = out.get(j, 0) + r["n"]
    return sum(r["n"] for r in rows), sum(r["c"] for r in rows) * 3 // 40, out


def linked(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n) of all documents (doc_id, text, node), and (node, root) of all nodes that have links."""
    spark = docs.sparkSession
    rows, expected, population = populations(docs)
    buckets = max(1, common.partitions(spark), expected // BUCKET)
    ordinary = common_shingles(docs, rows)
    described = scratch.keep(describe(docs, min(buckets, BUCKETS), population, ordinary), "described")
    feats = scratch.keep(described.where("bucket IS NULL").select("doc_id", "node", "n"), "feats")
    # a node has one row for each task that met it first
    sets = described.where("sketch IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = scratch.keep(sets, "sets")
    met = scratch.keep(meet(described.where("bucket IS NOT NULL").select("bucket", "payload"), buckets), "met")
    del described
    scratch.drop("described")
    groups = scratch.keep(met.where("grp IS NOT NULL").select("grp", "node").distinct(), "groups")
    texts = scratch.keep(pairs.texts_of(groups, docs), "texts", compression="zstd")
    tried = scratch.keep(
        met.where("pivot IS NOT NULL").groupBy("node", "pivot").agg(F.sum("shared").alias("_s"))
        .groupBy(F.col("node").alias("a")).agg(F.max_by("pivot", F.struct("_s", -F.col("pivot"))).alias("b")),
        "tried-0",
    )
    scratch.drop("met")
    links = scratch.keep(verify(tried, texts), "linked-0")
    roots = scratch.keep(components(links, scratch, "roots-0"), "found-0")
    step, last = 0, False
    while not last:
        step, last = step + 1, step >= ROUNDS
        members = groups.join(roots, "node", "left").select("grp", "node", F.coalesce("root", "node").alias("comp"))
        mixed = members.groupBy("grp").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a <> _b").select("grp")
        # what is open only shrinks: groups within one component are settled
        left = scratch.keep(members.join(mixed, "grp", "left_semi"), f"left-{step}")
        more = across(left.join(sets, "node"), not last, scratch, f"large-{step}").select("a", "b")
        more = scratch.keep(more.join(tried, ["a", "b"], "left_anti"), f"more-{step}")
        found = scratch.keep(verify(more, texts), f"linked-{step}")
        scratch.drop(f"left-{step}")
        tried = tried.unionByName(more)
        if not found.limit(1).count():
            if last:
                break
            step = ROUNDS
            continue
        links = links.unionByName(found)
        roots = scratch.keep(components(links, scratch, f"roots-{step}"), f"found-{step}")
    scratch.drop("texts", "groups", "sets")
    return feats, roots


def join(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), node, root."""
    scratch = scratch or Scratch(docs.sparkSession, "setjoin")
    feats, roots = linked(docs.select("doc_id", "text", common.text_key().alias("node")), scratch)
    # summed up by node and root before any join, so that no join sees more than the nodes
    least = feats.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("_least"))
    least = scratch.keep(least.join(roots, "node", "left").select("node", "_least", F.coalesce("root", "node").alias("root")), "least")
    of_root = scratch.keep(least.groupBy("root").agg(F.min("_least").alias("component_id")), "components")
    by_node = scratch.keep(least.join(of_root, "root").select("node", "root", "component_id"), "by-node")
    some = feats.where("n > 0").join(by_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "node", "root")
    none = feats.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "node", F.col("node").alias("root"))
    return some.unionByName(none)
