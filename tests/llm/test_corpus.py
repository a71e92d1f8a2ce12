"""The corpus operators on edge cases, against brute force, and on round trips."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trajectra.llm import bpe, contamination, html, lines, neighbours, passages, pieces, quality, queries, setjoin, shards, tokenfile, words
from trajectra.llm.common import Scratch, fresh

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, score double"
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(rb"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 97}x{i % 13}" for i in range(3000))
ODD = [
    (1, None, "en", "a", 0, "x", 0.0), (2, "", None, "a", 0, "x", 0.0), (None, "lone words here", "en", None, None, "x", 0.0), (4, LONG, "en", "a", 1, "x", 0.0),
    (5, LONG, "en", "a", 1, "x", 0.0), (6, LONG + " more", "en", "b", 1, "x", 0.0), (6, LONG + " more", "en", "b", 1, "x", 0.0), (8, " \n ", "en", "b", 1, "x", 0.0),
    (9, "é  two  blanks\n\nand lines \n", "fr", "b", 1, "x", 0.0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def _lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def test_words(monkeypatch):
    rng, seen = np.random.default_rng(1), {}
    parts = ["a", "B", " ", "\n", "é", "9", ".", "xyz", "\0", "  ", "q" * 30, "\x7f", "\x0b", "漢"]
    for tile in (words.TILE, 7, 1):
        monkeypatch.setattr(words, "TILE", tile)
        for inside, pattern in ((words.BLANK, BLANK), (words.ALNUM, ALNUM)):
            for _ in range(40):
                texts = [None if rng.random() < 0.1 else "".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(rng.integers(0, 9))]
                h, counts = words.hashed(pa.array([*texts, "x"], pa.string()).slice(0, len(texts)), inside)
                want = [pattern.findall(_lower(t)) for t in texts]
                assert counts.tolist() == [len(w) for w in want]
                for word, x in zip([w for row in want for w in row], h.tolist(), strict=True):
                    assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


def test_forest_against_plain_code():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (300, 4)).astype(float)
    y = ((x[:, 1] > 4) ^ (x[:, 2] > 6)).astype(float)
    forest = quality.fit_forest(x, y, trees=5, depth=2, least=1.0)

    def walk(row):
        total = forest.base
        for t in range(5):
            node = 0
            for _ in range(2):
                node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.threshold[t, node])
            total += forest.value[t, node]
        return total

    assert np.allclose(forest.margin(x), [walk(r) for r in x])
    # the first split has the largest gain of all
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = {}
    for j in range(4):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            gain[j, cut] = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))
    assert np.isclose(gain[int(forest.feature[0, 0]), np.floor(forest.threshold[0, 0])], max(gain.values()))


def test_quality(spark, odd):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    forest = quality.train(d, labels)
    held = d.where(quality.held_out()).join(labels, "doc_id")
    rows = quality.score(held, forest).select("score", "quality").collect()
    right = sum((r.score >= quality.THRESHOLD) == (r.quality == 1) for r in rows) / len(rows)
    assert len(rows) > 500 and right > 0.97
    assert all(0 <= r.score <= 1 for r in quality.score(odd, forest).collect())
    kept = quality.score(odd, forest, out=fresh(odd, "score")).collect()
    assert all(r.score == 0.0 and 0 <= r._score <= 1 and r.node == "x" for r in kept)
    assert quality.score(odd.limit(0), forest).count() == 0
    empty = quality.train(d, labels.limit(0))
    assert {r.score for r in quality.score(odd.drop("score"), empty).collect()} == {0.5}


def test_token_files(spark, docs, odd, tmp_path):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for name, df in (("docs", docs), ("odd", odd), ("none", odd.limit(0))):
        path = f"file://{tmp_path}/{name}"
        tokenfile.write(df, path, public_tokenizers.path("byte_bpe_50k.json"), block_tokens=5000)
        got = sorted(tokenfile.digest(spark, path).collect(), key=lambda r: r.start)
        rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        start = 0
        for r, (doc_id, text) in zip(got, rows, strict=True):
            ids = [*enc.encode_ordinary(text), 2]
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)


def test_codec_and_pieces():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        docs = [rng.integers(0, 2**32, n, np.uint64).astype(np.uint32), rng.integers(0, 300, 2 * n).astype(np.uint32)]
        ids, back = tokenfile.unpack(tokenfile.pack([7, None], docs))
        assert ids == [7, None] and all((a == b).all() for a, b in zip(docs, back, strict=True))
    enc = pieces.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), limit=50)
    for text in ["", " ", "a  b", " a", "a ", "don't, stop. now", "x\n y", "\n\na b", "é. ü", "z" * 3000, "a .b ,c", LONG]:
        want = bpe.encode(text, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
        assert enc.encode(text).tolist() == want
        assert "".join(pieces.cut(text)) == text


def test_pieces_of_many_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, plain, rng = pieces.PieceEncoder(path, limit=200), Tokenizer.from_file(path), np.random.default_rng(3)
    parts = ["x", " ", "a.", "don't", "\n", "  ", "é", "hello", "12", ",", "", "\t", "漢字", "🙂", "ɐ.", "'s", "<|endoftext|>", "A "]
    assert enc.encode("x <|endoftext|> y").tolist() == [87, 220, 50256, 331]  # as the library has it by default
    for _ in range(400):
        texts = ["".join(rng.choice(parts) for _ in range(rng.integers(0, 9))) for _ in range(rng.integers(0, 6))]
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in enc.encode_all(texts)] == want
        assert [x.tolist() for x in enc.stream(texts, chars=10)] == want


def _cosines(x, q):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u[q]


def test_neighbours(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    chosen, fit = [], neighbours.fit
    monkeypatch.setattr(neighbours, "fit", lambda *a: chosen.append(fit(*a)) or chosen[-1])
    got = {}
    for r in neighbours.nearest(d.withColumn("key", F.lit(1)).withColumn("q", F.lit(2))).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    p = d.toPandas()
    x, ids = np.stack(p.embedding.to_numpy()).astype(float), p.vec_id.to_numpy()
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = np.round(_cosines(x, q), 12)
        best = [ids[i] for i in np.lexsort((ids, -s)) if i != q][:5]
        hits += len(set(best) & set(got[ids[q]]))
    print(f"recall {hits / (5 * len(got)):.3f}, on the sample {chosen[0].recall:.3f}, vectors compared by a query {chosen[0].share:.3f} of all")
    assert hits / (5 * len(got)) >= 0.9 and all(len(v) == 5 for v in got.values())


def test_neighbours_select_in_clusters():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((100, 64))
    x = centres[rng.integers(0, 100, 4000)] + 0.3 * rng.standard_normal((4000, 64))
    found = neighbours.fit(neighbours._unit(x), 10**9)
    print(f"recall {found.recall:.3f}, vectors compared by a query {found.share:.4f} of all")
    assert found.recall >= neighbours.TARGET and found.share < 0.1
    assert neighbours.perturbations(2, 5) == [(), (0,), (1,), (0, 1), (2,)]


def test_candidates_are_merged_and_compared_once(spark, monkeypatch):
    """Against a plain search of the same buckets, in small shards and blocks, by product and by gathering."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 6))
    x = centres[rng.integers(0, 12, 700)] + 0.3 * rng.standard_normal((700, 6))
    x[50], x[51:60] = x[100], x[200]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    t = neighbours.Tables(6, 2, 2, 1.0, 5)
    unit = neighbours._unit(x)
    places = t.places(unit)
    mask = t.found([t.key(i, t.visits(p[::50])) for i, p in enumerate(places)], t.sorted(t.keys(places)))
    for q in range(len(mask)):
        want = set()
        for i in range(2):
            visits = {tuple(v) for v in t.visits(places[i, 50 * q : 50 * q + 1])[0].tolist()}
            want |= {j for j in range(700) if tuple(np.floor(places[i, j]).tolist()) in visits}
        assert set(np.flatnonzero(mask[q]).tolist()) == want
    assert 0.01 < mask.mean() < 0.6
    want = {}
    for n, q in enumerate(range(0, 700, 50)):
        found = [j for j in np.flatnonzero(mask[n]).tolist() if j != q]
        if len(np.flatnonzero(mask[n])) <= 5:
            found = [j for j in range(700) if j != q]
        want[q] = sorted((-neighbours.cosine(x[q], x[j]), j) for j in found)[:5]
    monkeypatch.setattr(neighbours, "fit", lambda *a: t)
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    for shard, dense in ((8192, 0), (90, 10**9)):
        monkeypatch.setattr(neighbours, "SHARD", shard)
        monkeypatch.setattr(neighbours, "DENSE", dense)
        got = {}
        for r in neighbours.nearest(rows).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert got == want


def test_neighbours_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (50, [1.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 7), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 7)]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_shards(spark, docs, odd):
    for df in (docs, odd, odd.limit(1), odd.limit(0)):
        rows = shards.assign(df).collect()
        assert len(rows) == df.count()
        slots: dict = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots.get(i, [])) for i in range(8)]
        assert max(counts) - min(counts) <= 1
        want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in df.select("doc_id", "text").collect())
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    for n in (1, 2, 3, 50, 1000):
        got = [r[0] for r in spark.range(n).orderBy("id").select(shards.permute(F.col("id"), n)).collect()]
        assert got == [_walk(i, n) for i in range(n)] and sorted(got) == list(range(n))
    rows = sorted(df_rows(docs), key=lambda r: (r[0], r[1], r[2]))
    want = Counter((*r, _walk(i, len(rows)) % 8, _walk(i, len(rows)) // 8) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in shards.assign(docs).collect()) == want


def df_rows(df):
    return [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in df.select("doc_id", "text").collect()]


def _walk(row, n, key=shards.KEY):
    """The permutation in plain code: rounds alternate between the halves, and numbers outside walk on."""
    a = next(x for x in range(1, n + 2) if x * x >= n)
    b = -(-n // a)

    def mixed(x, k, modulus):
        once = (x + k) % shards.PRIME
        twice = (once * once + k % 65537) % shards.PRIME
        return (twice * (twice % 1048573 + 1) + once) % shards.PRIME % modulus

    while True:
        u, low = divmod(row, b)
        for i, k in enumerate(key):
            if i % 2:
                low = (low + mixed(u, k, b)) % b
            else:
                u = (u + mixed(low, k, a)) % a
        row = u * b + low
        if row < n:
            return row


def _brute_components(rows):
    sets = []
    for d, t in rows:
        w = BLANK.findall(_lower(t))
        k = min(5, len(w))
        sets.append((d, {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least: dict = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets))


def test_set_join(docs, odd):
    for df in (docs, odd):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.join(df).collect())
        assert got == _brute_components(rows)
    assert setjoin.join(odd.limit(0)).count() == 0


def test_set_join_of_bounded_tasks(docs, odd, monkeypatch):
    some = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = _brute_components([tuple(r) for r in some.collect()])
    for name, value in (("GROUP", 3), ("ROUNDS", 0), ("PACK", 1000), ("HOLD", 2000), ("BUCKETS", 3)):
        monkeypatch.setattr(setjoin, name, value)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.join(some).collect()) == want


def test_signatures_never_miss():
    rng = np.random.default_rng(5)
    for population in (10, 10**9):
        every = {j: population for j in range(100)}
        for n in (1, 2, 3, 4, 5, 9, 16, 30, 45, 100, 400, 2000):
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, n, np.uint64))
                b = a.copy()
                for _ in range(max(1, n // 18)):
                    i = rng.integers(0, len(b))
                    b = (b[:i], np.delete(b, i), np.r_[b, rng.integers(0, 2**63, 1, np.uint64)])[rng.integers(1, 3)]
                    b = b if len(b) else a.copy()
                b = np.unique(b)
                if not setjoin.similar(a, b):
                    continue
                for share in (0, 0.4, 0.8, 1):
                    ordinary = np.union1d(a, b) if share == 1 else np.sort(rng.permutation(a)[: int(share * len(a))])
                    sig, own = setjoin.signatures(np.r_[a, b], np.array([len(a), len(b)]), every, ordinary)
                    assert np.intersect1d(sig[own == 0], sig[own == 1]).size
                folded = setjoin._folded([setjoin.sketch(a), setjoin.sketch(b)])
                assert setjoin._slack(np.array([len(a)]), folded[:1], np.array([len(b)]), folded[1:])[0, 0] >= 0


def test_passages(spark, docs, odd):
    found = passages.repeated(odd.where("doc_id <> 6"))
    assert {(r.doc_id, r.begin, r.end, r.partner_id) for r in found.collect()} == {(4, 0, 3000, 5), (5, 0, 3000, 4)}
    assert passages.repeated(odd.limit(0)).count() == 0
    shared, rng = [f"p{i}" for i in range(60)], np.random.default_rng(3)
    own = lambda: [f"u{x}" for x in rng.integers(0, 10**9, 80)]
    fuzzy = [w for i, w in enumerate(shared) if i != 30]
    texts = [own() + shared + own(), own() + shared, own() + fuzzy + own(), own()]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.begin, r.end) for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (80, 140), 1: (80, 140), 2: (80, 139)}


def _common_stretches(a, b, least=50):
    """Maximal stretches of words of a that stand in b, by comparing all places."""
    out, before = [], {}
    for i, x in enumerate(a):
        now = {j: before.get(j - 1, 0) + 1 for j, y in enumerate(b) if x == y}
        out += [(i + 1 - n, i + 1) for j, n in now.items() if n >= least and not (i + 1 < len(a) and j + 1 < len(b) and a[i + 1] == b[j + 1])]
        before = now
    return out


def test_passages_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    own = lambda n: [f"u{x}" for x in rng.integers(0, 400, n)]
    line = own(12)
    shared = [own(50), own(70), line * 5, own(10) * 7]
    texts = []
    for i in range(14):
        parts = [own(int(rng.integers(5, 90)))]
        for p in rng.permutation(4)[: int(rng.integers(0, 3))]:
            parts += [shared[p], own(int(rng.integers(5, 60)))]
        texts.append([w for x in parts for w in x] + line * (i % 3))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got: dict = {}
    for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.begin, r.end))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            for begin, end in _common_stretches(a, b) if i != j else ():
                assert any(x <= begin and end <= y for x, y in got.get(i, ())), (i, j, begin, end)


def test_chains_are_cut_at_gaps():
    for n in (60, 200):
        for gap in range(n // 2 + 1, n, 7):
            p, q, x = np.arange(n), np.arange(n) + 1000, np.arange(gap) + 2000
            found = passages.align(np.r_[p, x, q].astype(np.uint64), np.r_[p, q].astype(np.uint64))
            covered = {i for a0, a1, *_ in found for i in range(a0, a1)}
            assert {*range(n), *range(n + gap, 2 * n + gap)} <= covered


def test_passages_that_stand_twice():
    p, own = np.arange(60, dtype=np.uint64), lambda n, i: np.arange(1000 * i, 1000 * i + n, dtype=np.uint64)
    fuzzy = np.where(np.arange(60) % 10 == 9, 500 + p, p)
    for b in (p, np.r_[own(70, 1), p]):
        for first, both in ((p, True), (fuzzy, True), (p[:30], False)):
            a = np.r_[first, own(200, 2), p, own(80, 3)]
            for x, y, side in ((a, b, 0), (b, a, 2)):
                spans = {f[side : side + 2] for f in passages.align(x, y)}
                copy = len(first) + 200
                assert any(s <= copy and e >= copy + 60 for s, e in spans)
                assert any(s == 0 and e >= len(first) - 1 for s, e in spans) == both
    same = np.tile(own(10, 4), 300)
    assert (0, 3000, 0, 3000, 1.0) in passages.align(same, same)


def test_fuzzy_and_repetitive_passages_are_candidates(spark):
    rng = np.random.default_rng(5)
    own = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    texts = []
    for n, every in ((60, 5), (60, 7), (60, 8), (60, 10), (80, 5), (80, 7)):
        p = own(n)
        texts += [own(70) + p + own(70), own(40) + [f"v{i}" if i % every == every // 2 else w for i, w in enumerate(p)] + own(90)]
    sentence = own(10)
    texts += [own(70) + sentence * 5 + own(30), own(20) + sentence * 5 + own(80)]
    found = passages.repeated(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.partner_id for r in found} == {i: i ^ 1 for i in range(len(texts))}
    assert all(r.end - r.begin >= 50 for r in found)


def test_runs_against_all_places():
    rng = np.random.default_rng(1)
    for n, m, words_ in ((0, 9, 3), (4, 4, 1), (40, 60, 2), (60, 50, 3), (120, 90, 30)):
        for _ in range(20):
            a, b = (rng.integers(0, words_, x).astype(np.uint64) for x in (n, m))
            want = []
            for i in range(len(a)):
                for j in range(len(b)):
                    if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                        size = 0
                        while i + size < len(a) and j + size < len(b) and a[i + size] == b[j + size]:
                            size += 1
                        if size >= passages.K:
                            want.append([i, j, size])
            assert passages.runs(a, b).tolist() == want


def test_covered_words_without_all_chains(monkeypatch):
    """What passages cover is the same as by chaining all runs, but K-mers are hashed once a text, and most runs are not chained."""
    rng = np.random.default_rng(2)
    common = lambda n: [f"c{x}" for x in rng.zipf(1.4, n) % 500]
    lines = [common(9) for _ in range(4)] + [common(70)]
    texts = []
    for k in range(12):
        p = common(130)
        texts.append(common(60) + p + common(80) + [w for x in rng.integers(0, 5, 12) for w in lines[x]])
        texts.append(_edited(rng, texts[-1], 6 + k, "any") if k % 3 == 0 else common(200) + _edited(rng, p, 9, "replaced") + [w for x in rng.integers(0, 5, 9) for w in lines[x]])
    counted, chained, grams, chains = [], [], passages.common.grams, passages.chains
    monkeypatch.setattr(passages.common, "grams", lambda h, k: counted.append(len(h)) or grams(h, k))
    kmers = passages.Kmers.of_texts(pa.array([" ".join(t) for t in texts]))
    monkeypatch.setattr(passages, "chains", lambda found: chained.append(len(found)) or chains(found))
    pairs = [(a, b) for i, a in enumerate(kmers) for b in kmers[:i]]
    got = [passages.covered(a, b) for a, b in pairs]
    assert len(counted) == 1
    few = sum(chained)
    chained.clear()
    monkeypatch.setattr(passages, "hopeful", lambda found, *_, **__: found)
    found = [passages.align(a, b) for a, b in pairs]
    for sides, each in zip(got, found, strict=True):
        for side, spans in enumerate(sides):
            assert {w for x, y in spans for w in range(x, y)} == {w for f in each for w in range(f[2 * side], f[2 * side + 1])}
            assert all(x[1] < y[0] for x, y in zip(spans[:-1], spans[1:], strict=True))
    assert sum(map(len, found)) > 50 and few < 0.6 * sum(chained), (few, sum(chained))


def test_repeated_lines_in_linear_time():
    line = np.arange(10, dtype=np.uint64)
    a, b = np.tile(line, 20_000), np.r_[np.tile(line, 15_000), np.arange(100, 400, dtype=np.uint64)]
    began = time.time()
    found = passages.align(a, b)
    assert any(s[0] == 0 and s[1] >= 150_000 for s in found) and time.time() - began < 60


def test_packed_seeds():
    rng = np.random.default_rng(4)
    for n, nodes in ((0, 1), (1, 1), (2000, 3), (3000, 2000)):
        sig, place = rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**16, n).astype(np.uint16)
        node = rng.integers(0, 2**40, nodes, np.uint64)[rng.integers(0, nodes, n)]
        bucket = setjoin.bucket_of(sig, 3)
        got = [(b, *x) for b, p in passages._packed(sig, node, bucket, place) for x in zip(*(c.tolist() for c in passages._opened(p)), strict=True)]
        assert sorted(got) == sorted(zip(bucket.tolist(), (sig & np.uint64(2**32 - 1)).tolist(), node.tolist(), place.tolist(), strict=True))


def _edited(rng, words, every, kind):
    """One word in `every` is replaced, left out or followed by another."""
    out, first = [], rng.integers(0, every)
    for i, w in enumerate(words):
        what = kind if i % every == first else "none"
        if what == "any":
            what = rng.choice(["replaced", "left out", "added"])
        out += {"none": [w], "replaced": [f"e{rng.integers(0, 10**9)}"], "left out": [], "added": [w, f"e{rng.integers(0, 10**9)}"]}[what]
    return out


def _share_enough_seeds(a, b):
    (x, at_a), (y, at_b) = passages.seeds(a), passages.seeds(b)
    _, i, j = np.intersect1d(x, y, return_indices=True)
    band, unit = (at_a[i] - at_b[j]).view(np.int16).astype(int) >> 4, at_a[i].astype(int)
    near = [unit[(band == k) | (band == k + 1)] for k in set(band.tolist())]
    return any(len(u) >= passages.LEAST_SEEDS and np.ptp(u) >= passages.LEAST_UNITS for u in near)


def test_seeds_in_parts(spark, docs, monkeypatch):
    """The parts that are shuffled one after the other hold each seed once, a third each, and give the same passages."""
    rng = np.random.default_rng(3)
    h = rng.integers(0, 300, 6000).astype(np.uint64)
    counts = np.array([0, 2000, 5, 3995])
    whole, parts = passages.seeds_of(h, counts), [passages.seeds_of(h, counts, i, 3) for i in range(3)]
    rows = lambda found: sorted(zip(*(x.tolist() for x in found), strict=True))
    assert rows(whole) == sorted(r for p in parts for r in rows(p)) and len(set(rows(whole))) == len(whole[0])
    assert rows(x[whole[2] == 1] for x in whole[:2]) == rows(passages.seeds(h[:2000]))
    assert max(len(p[0]) for p in parts) < 0.4 * len(whole[0])
    ordered = lambda: sorted(map(tuple, passages.repeated(docs).collect()), key=str)
    expected = ordered()
    monkeypatch.setattr(passages, "PART", 1000)
    assert expected and ordered() == expected


def test_every_fuzzy_passage_shares_seeds():
    """Of 300 passages of each kind, with an edit every 5 to 7 words, none that aligns lacks the seeds of a candidate."""
    rng, aligned = np.random.default_rng(0), 0
    hashed = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    for every in (5, 6, 7):
        for kind in ("replaced", "left out", "added", "any"):
            for _ in range(300):
                p = hashed(60)
                codes = _edited(rng, p.tolist(), every, kind)
                edited = np.array([hash(w) if isinstance(w, str) else w for w in codes], np.int64).astype(np.uint64)
                a, b = np.r_[hashed(int(rng.integers(0, 40))), p], np.r_[hashed(int(rng.integers(0, 40))), edited]
                if passages.align(a, b):
                    aligned += 1
                    assert _share_enough_seeds(a, b), (every, kind)
    assert aligned > 2000


def test_fuzzy_passages_against_all_pairs(spark):
    """Planted passages with edits every 5 to 8 words, in corpora of common words of three sizes: every pair that aligns is found."""
    for size in (60, 240, 960):
        rng = np.random.default_rng(size)
        common = lambda n: [f"c{x}" for x in (rng.zipf(1.3, n) % 3000)]  # noqa: E731, B023
        texts = [common(rng.integers(60, 200)) for _ in range(size)]
        for k in range(0, 40, 2):
            p = common(64)
            texts[k] = common(40) + p + common(50)
            texts[k + 1] = common(50) + _edited(rng, p, 5 + k // 2 % 4, "any" if k % 8 >= 4 and k // 2 % 4 > 0 else "replaced") + common(40)
        vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        hashed = [np.array([vocabulary[w] for w in t], np.uint64) for t in texts]
        got = {r.doc_id: (r.begin, r.end, r.partner_id) for r in passages.repeated(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
        aligned = [k for k in range(0, 40, 2) if passages.align(hashed[k], hashed[k + 1])]
        missed = [k for k in aligned if got.get(k, (0, 0, -1))[2] != k + 1 or got.get(k + 1, (0, 0, -1))[2] != k]
        print(f"{size} texts: {len(aligned) - len(missed)} of {len(aligned)} planted fuzzy passages found")
        assert len(aligned) >= 15 and not missed
        assert not [d for d in got if d >= 40]  # texts without a planted passage are left alone


def test_passages_of_repeated_rows_and_long_texts(spark):
    rng = np.random.default_rng(8)
    p = [f"p{i}" for i in range(60)]
    own = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    long = own(100_000) + p + own(50_000)
    two, three = (2, " ".join(own(30) + p)), (3, " ".join(own(10) + p))
    rows = [(1, " ".join(long)), two, two, three, three, (None, " ".join(p + own(5)))]
    rows += [rows[-1], (5, None), (6, "")]
    found = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("n"), "begin": F.lit(0)}))
    rows_ = found.collect()
    got = Counter((r.doc_id, r.begin, r.end) for r in rows_)
    assert got == {(1, 100_000, 100_060): 1, (2, 30, 90): 1, (3, 10, 70): 1, (None, 0, 60): got[(None, 0, 60)]} and got[(None, 0, 60)] >= 1
    assert all(r.partner_id in {1, 2, 3} - {r.doc_id} for r in rows_)


def test_decontamination(spark, docs, odd):
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    extra = spark.createDataFrame([(900, "lone words here"), (901, ""), (902, None), (None, "two blanks"), (900, "lone words here")], "item_id long, text string")
    for df, items in ((docs, bench), (odd, extra), (odd, extra.limit(0)), (odd.limit(0), extra)):
        texts = [tuple(r) for r in items.collect()]
        phrases: dict = {}
        for item, text in texts:
            w = ALNUM.findall(_lower(text))
            for i in range(max(1, len(w) - 9) if w else 0):
                phrases.setdefault(tuple(w[i : i + 10]), set()).add(item)
        want = Counter()
        for doc_id, text in df.select("doc_id", "text").collect():
            w = ALNUM.findall(_lower(text))
            hit, ids = set(), set()
            for size in {len(p) for p in phrases}:
                for i in range(len(w) - size + 1):
                    if (p := tuple(w[i : i + size])) in phrases:
                        hit.update(range(i, i + size))
                        ids |= {str(x) for x in phrases[p] if x is not None}
            want[(doc_id, len(w), len(hit), tuple(sorted(ids)))] += 1
        for size in (100, 10**6):
            again = Scratch(spark, "index").keep(contamination.build(df, size), "segments")
            assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in contamination.search(again, items).collect()) == want
        index = Scratch(spark, "index").keep(contamination.build(df, 3000), "segments")
        for block in (contamination.PHRASES, 300):
            got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in contamination.search(index, items, block=block).collect())
            assert got == want


def test_phrase_and_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "d c q b a"), (3, "a b z z z c d"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d"), (8, "")], "item_id long, text string")
    index = Scratch(spark, "index").keep(contamination.build(docs), "segments")
    assert [tuple(r) for r in contamination.matches(index, bench).collect()] == [(1, "7", 1, 5)]
    near = {(r.doc_id, r.item_id) for r in contamination.proximity(index, bench, 4).collect()}
    assert near == {(1, "7"), (2, "7")}
    assert {r.doc_id for r in contamination.proximity(index, bench, 6).collect()} == {1, 2, 3}


def test_bpe_query_against_the_library(spark, docs, odd):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = bpe.encoding(path, pattern)
    for df in (docs, odd, odd.limit(0)):
        want = Counter()
        for doc_id, text in df.select("doc_id", "text").collect():
            ids = enc.encode_ordinary(text or "")
            want[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in bpe.round_trip(df, path, pattern).collect()) == want


def test_bpe(odd):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    want = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in bpe.round_trip(odd, path, pattern).collect()) == want
    for text in ["a" * 50, LONG, "x  y" * 40, " ".join(["don't"] * 50), "\n \n".join("abc")]:
        assert bpe.encode(text, path, pattern, 20) == bpe.encode(text, path, pattern, 10**9)
        assert "".join(bpe.chunks(text, 20)) == text


def test_line_dedup(spark, odd):
    rows = [(i, "h" if i < 10 else None, f"menu\nown {i}\n\nmenu" if i % 2 else None if i == 0 else f"own {i}") for i in range(20)]
    got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[1].text == "own 1\n" and got[1].n_dropped == 2 and got[11].text == "own 11\n" and got[2].text == "own 2"
    assert got[0].text is None and (got[0].n_lines, got[0].n_dropped) == (0, 0)
    assert lines.dedup(odd).count() == len(ODD) and lines.dedup(odd.limit(0)).count() == 0
    clash = odd.select("*", *[F.lit(1).alias(c) for c in ("_host", "_drop", "_kept", "_salt", "_row", "n_lines", "n_dropped")])
    got = lines.dedup(clash)
    assert sorted(got.columns) == sorted(clash.columns) and got.count() == len(ODD)
    assert {(r._host, r._drop, r._salt) for r in got.collect()} == {(1, 1, 1)}


def test_line_dedup_against_sql(spark):
    import duckdb

    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
        want = db.execute(f"SELECT doc_id, source, text, n_lines, n_dropped FROM ({queries.ORACLE_SQL['op9_line_dedup']})").fetchall()
    assert Counter(map(tuple, queries.op9_line_dedup(spark, DIR).collect())) == Counter(want)


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>if (a<b) x('</p>')</script></head><body class='home'><nav><ul><li><a href='/'>Home</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies on this site, please accept them all now.</div><article><h1>Head &amp; line</h1><p>One <b>bo</b>ld\n"
        " word.<br><p>Two&nbsp;words<aside>Related: something else</aside><p>Three.</p><form>Sign up <input></form><div id=comments><p>A long reader comment"
        " that says a lot of things about the article and more.</p></div></article><footer>&copy; us</footer></body></html>"
    )
    assert html.main_text(page) == "Head & line One bold word. Two words Three."
    rows = [(1, "u", None), (2, "u", ""), (3, None, page), (4, "u", "<p>" + "words and more words in a paragraph " * 5)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "" and got[2] == "" and got[3].startswith("Head") and got[4].startswith("words and")


PARAGRAPH = "<p>" + "words and more words in a paragraph here " * 4 + "</p>"


def test_html_structures():
    text = PARAGRAPH[3:-5].strip()
    wrapped = f'<div class="has-sidebar share-enabled"><article><h1>T</h1>{PARAGRAPH}<div class="share">tweet this</div></article></div>'
    assert html.main_text(wrapped) == f"T {text}"
    assert html.main_text(f'<div class="page has-sidebar">{PARAGRAPH}{PARAGRAPH}<div class=sidebar>side things here</div></div>') == f"{text} {text}"
    listed = f"{PARAGRAPH}<ul><li>one item here<li>two items are here<li>three items</ul>{PARAGRAPH}"
    assert html.main_text(listed) == f"{text} one item here two items are here three items {text}"
    linked = f"{PARAGRAPH}<ul>" + "<li><a href=/>go there</a>" * 4 + "</ul>"
    assert html.main_text(linked) == text
    for tag in ("noscript", "template", "textarea"):
        assert html.main_text(f"<article><p>before <{tag}> in it {PARAGRAPH}") == f"before in it {text}"
    assert html.main_text("<article>a < b & c &lt; d <br>more") == "a < b & c < d more"
    # comments, notices and discussions go at any length, also if they hold most of the words
    title = f"<h1>T</h1>{PARAGRAPH}"
    for name in ('<div class="comments">', "<section class='discussion'>", "<div id=cookie-notice>", '<div class="alert alert-info">', "<div role=alert>", "<ul class='comment-list'>"):
        assert html.main_text(f"<article>{title}{name}{PARAGRAPH * 9}</div></section></ul></article>") == f"T {text}"
        assert html.main_text(f"<article>{title}</article>{name}{PARAGRAPH * 9}") == f"T {text}"
        assert html.main_text(f"{title}{PARAGRAPH}{name}{PARAGRAPH * 9}") == f"T {text} {text}"
    # a state of a wrapper is no name
    assert html.main_text(f'<div class="comments-open with-sidebar">{PARAGRAPH * 2}</div>') == f"{text} {text}"
    # an article's header holds its title, the page's does not
    assert html.main_text(f"<header><h1>Site</h1></header><article><header><h1>Title here</h1></header>{PARAGRAPH}</article>") == f"Title here {text}"
    # in an article, a list of links goes and a linked line stays
    links = "<ul>" + "<li><a href=/>read that</a>" * 3 + "</ul>"
    assert html.main_text(f"<article>{PARAGRAPH}<p><a href=/>one link</a></p>{PARAGRAPH}{links}</article>") == f"{text} one link {text}"


def test_numbers_decide_wherever_a_block_stands():
    """For every standing there are blocks that are kept or dropped by their neighbours' numbers alone."""
    sizes, densities = (1, 6, 25, 60, 110, 160), (0.0, 0.3, 1.0)
    for place in range(1, 6):
        by_own = [
            {html.keeps((n, d, a, x, b, y, place)) for a in sizes for x in densities for b in sizes for y in densities} for n in sizes for d in densities
        ]
        assert {True, False} in by_own, place
        every = [html.keeps((n, d, 30, 0.0, 30, 0.0, place)) for n in sizes for d in densities]
        assert any(every) or place == 2
    for n in range(1, 200):  # plain text in an article stays, whatever is around it
        assert all(html.keeps((n, 0.1, a, x, b, y, 5)) for a in sizes for x in densities for b in sizes for y in densities)


def test_html_on_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, None, f"<article>{PARAGRAPH}", "old", 3)] * 2 + [(None, "u", None, None, None), (2, "u", "   \n ", "x", 1), (3, "u", PARAGRAPH * 30_000, "", 0)]
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows, schema)).collect())
    text = PARAGRAPH[3:-5].strip()
    assert got == [(0, "", None), (1, text, 3), (1, text, 3), (2, "", 1), (3, " ".join([text] * 30_000), 0)]
    none = html.extract(spark.createDataFrame([], schema))
    assert none.count() == 0 and sorted(none.columns) == sorted(schema.replace(" long", "").replace(" string", "").split(", "))


@pytest.mark.parametrize("page", ['<a "', "<a \"'>", "<div>", "<div></p>", "<noscript>", "<", "<!--", "<p><b>x", "<div class='share x'>y", "<![CDATA["])
def test_html_in_linear_time(page):
    began = time.time()
    html.main_text(page * (1_000_000 // len(page)))
    assert time.time() - began < 20


def _without_boilerplate(rows):
    pages, on = Counter(r.source for r in rows), Counter()
    for r in rows:
        on.update({(r.source, x.strip(" ")) for x in (r.text or "").split("\n") if x.strip(" ")})
    out = []
    for r in rows:
        kept = None
        if r.text is not None:
            kept = "\n".join(x for x in r.text.split("\n") if not (on[r.source, x.strip(" ")] >= lines.LEAST and on[r.source, x.strip(" ")] > lines.RATIO * pages[r.source]))
        out.append((r.doc_id, kept))
    return out


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "line_dedup", "jaccard_join", "decontamination", "byte_bpe"]
    d = spark.read.parquet(f"{DIR}/documents.parquet")
    forest = quality.train(d, spark.read.parquet(f"{DIR}/labels.parquet"))
    rows = [r for r in d.collect() if forest.score(np.array([quality.statistics(r.text)]))[0] >= quality.THRESHOLD]
    kept = _without_boilerplate(rows)
    least = {i: c for i, _, c in _brute_components(kept)}
    kept = [(i, t) for i, t in kept if least[i] == i]
    test = set()
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = ALNUM.findall(_lower(r.text))
        test |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    clean = []
    for i, t in kept:
        w = ALNUM.findall(_lower(t))
        if not any(tuple(w[k : k + n]) in test for n in {len(p) for p in test} for k in range(len(w) - n + 1)):
            clean.append((i, hashlib.sha256((t or "").encode()).hexdigest()))
    assert 0 < len(clean) < d.count()
    assert Counter((r.doc_id, r.decoded_sha256) for r in pipeline.run(spark, DIR).collect()) == Counter(clean)


def test_pipeline_stages_on_odd_tables(spark, odd):
    import corpus_pipeline as pipeline

    clash = odd.select("*", *[F.lit(5).alias(c) for c in ("_score", "_key", "_doc", "_nth", "n_lines", "n_dropped", "root", "n_hit")])
    for df in (clash, clash.unionByName(clash), clash.limit(0), clash.where("text IS NULL")):
        total = df.count()
        for name, stage in pipeline.STAGES[:4]:
            out = stage(spark, df, DIR)
            assert out.columns == df.columns, name
            rows = out.collect()
            assert all((r._score, r._key, r._doc, r._nth, r.n_lines, r.n_dropped, r.root) == (5,) * 7 for r in rows), name
            if name in ("line_dedup", "decontamination"):
                assert len(rows) == total, name
            if name == "jaccard_join":
                # texts without words stay, and one document of each group of the others
                assert len(rows) == sum(not BLANK.findall(_lower(r.text)) for r in df.collect()) + min(total, 3) * (total > 6)
        assert pipeline.byte_bpe(spark, df, DIR).count() == total
