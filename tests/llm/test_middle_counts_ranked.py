"""Fill-in-the-middle, token counts and ranked search against plain code, the library and brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trajectra.llm import middle, queries, ranked, tokencount, words

from .test_corpus import ALNUM, DIR, DOCS, ODD, _lower

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
HUGE = "lorem ipsum <b> dolor, é漢🙂 " * 60_000 + "z" * 400_000
CASES = [*ODD, (10, HUGE, "en", "a", 0, "x", 0.0), (11, "<P> inside", "en", "a", 0, "x", 0.0), (12, "a <S", "en", "a", 0, "x", 0.0)]


@pytest.fixture(scope="module")
def cases(spark):
    # extra columns whose names the operators use themselves
    return spark.createDataFrame(CASES, DOCS).withColumns({"n": F.lit(1), "form": F.lit("f"), "item": F.lit(2), "_h1": F.lit(3), "rank": F.lit(4)})


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _plain(doc_id, text):
    u = UNIT.findall(text or "")
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not u or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text or ""
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if h4 % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_scan_against_plain_code(monkeypatch):
    rng = np.random.default_rng(0)
    parts = ["a", "B", "<", "<P>", "P>", "<S", "M>", "é", "漢", "🙂", " ", "\n", "xyz" * 40, "<M>", ".", "q" * 300, "\0"]
    for lane in (2, 3, 256):
        monkeypatch.setattr(middle, "LANE", lane)
        for _ in range(100):
            texts = ["".join(rng.choice(parts) for _ in range(rng.integers(0, 14))) for _ in range(rng.integers(1, 6))]
            raw, at = words.bytes_of(pa.array(["..", *texts, "x"], pa.string()).slice(1, len(texts)))
            scan, units = middle.Scan(raw, at), [UNIT.findall(t) for t in texts]
            assert scan.n.tolist() == [len(u) for u in units] and scan.n_chars.tolist() == [len(t) for t in texts]
            assert [x > 0 for x in scan.hits] == [bool(re.search("<[PSM]>", t)) for t in texts]
            d, k = np.array([(i, j) for i, u in enumerate(units) for j in range(len(u) + 1)]).T
            heads = ["".join(units[i][:j]) for i, j in zip(d, k, strict=True)]
            byte, chars = scan.cuts(d, k)
            assert (byte - at[d]).tolist() == [len(x.encode()) for x in heads] and chars.tolist() == [len(x) for x in heads]


def test_fill_in_middle(spark, cases):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    for df in (docs, cases):
        rows = df.select("doc_id", "text").collect()
        out = middle.transform(df)
        got = out.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
        assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((r.doc_id, *_plain(r.doc_id, r.text)) for r in rows)
        assert Counter((r.doc_id, r.back) for r in got) == Counter((r.doc_id, r.text or "") for r in rows)
    forms = Counter(r.form for r in middle.transform(docs).collect())
    assert set(forms) == {"plain", "psm", "spm"} and forms["psm"] > forms["spm"] > 0
    assert middle.transform(cases.limit(0)).count() == 0
    got = {r.doc_id: r for r in queries.op11_fill_in_middle(spark, DIR).collect()}
    for r in docs.collect():
        assert got[r.doc_id].output_sha256 == _sha(_plain(r.doc_id, r.text)[-1]) and got[r.doc_id].restored_sha256 == _sha(r.text or "")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_counter_against_the_library(library):
    path, plain = library
    counter, rng = tokencount.TokenCounter(path, limit=300), np.random.default_rng(0)
    parts = ["a", "B", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'re", "'r", "''ll", "'S", "é", "é", "漢", "🙂", " ", "\n", "xyz" * 60, "Σ", "ΑΣ "]
    parts += ["İ", "q" * 300, "½", "١", "Ᲊ", "\U00010d50", "՘", "hello", "world", "12", "..", "\0", "‍", "\x85", "ﬁ", "̀", " ", "　"]
    for _ in range(300):
        texts = ["".join(rng.choice(parts) for _ in range(rng.integers(0, 14))) for _ in range(rng.integers(0, 6))]
        assert counter.count_all(texts) == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    for n in (tokencount.LONG, tokencount.LONG + 1, 5000):  # both ways of merging, and runs of one letter
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "aé漢b", "a"):
            text = "".join(rng.choice(list(letters), n))
            want = len(plain.encode(text, add_special_tokens=False).ids)
            assert counter.count_all([text]) == [want]
            raw = text.encode()
            assert int(counter.merged([raw])[0]) == counter.merged_long(raw) == want


def test_token_counts(spark, cases, library, monkeypatch):
    path, plain = library
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for df in (docs, cases):
        want = Counter(
            (r.doc_id, len((r.text or "").encode()), n, n > 2048)
            for r in df.collect() for n in [len(plain.encode(r.text or "", add_special_tokens=False).ids)]
        )
        assert Counter(tuple(r) for r in tokencount.count(df, path).collect()) == want
    assert tokencount.count(cases.limit(0), path).count() == 0
    text = "Ein  Satz, it's 12 <|endoftext|> é é\n" * 50
    monkeypatch.setattr(tokencount, "CHUNK", 7)
    assert tokencount.TokenCounter(path).count_all([text]) == [len(plain.encode(text, add_special_tokens=False).ids)]
    assert queries.op12_token_counts(spark, DIR).count() == docs.count()


def test_word_counts(monkeypatch):
    rng, parts = np.random.default_rng(1), ["a", "B", " ", "\n", "é", "9", ".", "xyz", "  "]
    for tile in (1, 3, 7):
        monkeypatch.setattr(words, "TILE", tile)
        for _ in range(60):
            texts = [None if rng.random() < 0.1 else "".join(rng.choice(parts, rng.integers(0, 20))) for _ in range(rng.integers(0, 6))]
            column = pa.array(["zz", *texts, "x"], pa.string()).slice(1, len(texts))
            assert words.counts(column, words.ALNUM).tolist() == [len(ALNUM.findall(_lower(t))) for t in texts]


def _least_cost(values, cost, widest):
    dp = [0]
    for j in range(1, len(values) + 1):
        dp.append(min(dp[j - k] + cost + k * max(values[j - k : j]) for k in range(1, min(widest, j) + 1)))
    return dp[-1]


def test_block_ends_are_the_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(100):
        starts = np.r_[0, np.cumsum(rng.integers(1, 40, rng.integers(1, 9)))]
        values, widest, cost = rng.integers(1, 100, starts[-1]), int(rng.integers(1, 9)), int(rng.integers(0, 200))
        ends = ranked.block_ends(values, starts, cost, widest, 64)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            own, total, at = [e for e in ends if a < e <= b], 0, a
            for e in own:
                total, at = total + cost + (e - at) * max(values[at:e]), e
            assert at == b and total == _least_cost(values[a:b].tolist(), cost, widest)


def _ranked(docs, items, k=10):
    """Every document scored for every item."""
    terms = [(d, ALNUM.findall(_lower(t))) for d, t in docs]
    n_docs, n_words = sum(1 for _, t in terms if t), sum(len(t) for _, t in terms)
    tf = [Counter(t) for _, t in terms]
    df = Counter(x for c in tf for x in c)
    out = []
    for item, text in items:
        asked, rows = Counter(ALNUM.findall(_lower(text))), []
        for (d, own), c in zip(terms, tf, strict=True):
            m = 100 - 75 + (75 * len(own) * n_docs) // max(n_words, 1)
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(rows)[:k])]
    return Counter(out)


def test_ranked_search(spark, cases):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text")
    rows, items = [tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()]
    want = _ranked(rows, items)
    assert Counter(tuple(r) for r in queries.op13_ranked_search(spark, DIR).collect()) == want
    # many small shards, and items in many blocks
    n_docs, n_words = ranked.totals(docs)
    index = ranked.build(docs.repartition(3), n_docs, n_words, size=3000)
    few = bench.limit(6)
    got = ranked.search(index, few, n_docs, block=40)
    assert Counter(tuple(r) for r in got.collect()) == _ranked(rows, [tuple(r) for r in few.collect()])
    odd = [("a", "lone words w1x1 w3x3"), ("a", "lone lone WORDS"), (None, "more"), ("b", ""), ("c", None), ("d", "nowhere"), ("e", "lorem dolor é漢🙂 z")]
    asked = spark.createDataFrame(odd, "item_id string, text string").withColumns({"item": F.lit(1), "score": F.lit(2)})
    own = [(r.doc_id, r.text) for r in cases.collect()]
    assert Counter(tuple(r) for r in ranked.best_documents(cases, asked).collect()) == _ranked(own, odd)
    for a, b in ((cases.limit(0), asked), (cases, asked.limit(0))):
        assert ranked.best_documents(a, b).count() == 0


def test_blocks_are_skipped():
    """The bound of an interval is never below a score in it, and low intervals are not read."""
    rng = np.random.default_rng(5)
    n = rng.integers(20, 400, 3000)
    docs = [rng.choice(2000, k, p=np.arange(2000, 0, -1) / 2001000) for k in n]
    h = np.concatenate(docs).astype(np.uint64)
    of = np.repeat(np.arange(len(docs)), n)
    order = np.lexsort((of, h))
    key, tf = np.unique(np.stack([h[order].astype(np.int64), of[order]]), axis=1, return_counts=True)
    starts = np.r_[np.flatnonzero(np.r_[True, np.diff(key[0]) > 0]), key.shape[1]]
    value = ranked.impacts(tf, n[key[1]], len(docs), int(n.sum()))
    row = type("Row", (), {
        "doc_ids": np.arange(len(docs), dtype="<i8").tobytes(), "there": np.ones(len(docs), np.uint8).tobytes(),
        "terms": key[0][starts[:-1]].astype("<u8").tobytes(), "starts": starts.astype("<i4").tobytes(), "docs": key[1].astype("<i4").tobytes(),
        "impacts": value.astype("<i4").tobytes(), "ends": ranked.block_ends(value, starts).astype("<i4").tobytes(),
    })
    shard, seen = ranked.Shard(row), []

    class Noted(ranked.Best):
        def add(self, score, ids, there):
            seen.append(len(ids))
            super().add(score, ids, there)

    for _ in range(30):
        terms = np.unique(rng.integers(0, 2000, 4)).astype(np.uint64)
        w = rng.integers(1, 5000, len(terms))
        best = Noted(10)
        shard.scores(terms, w, best)
        total = np.zeros(len(docs), np.int64)
        for t, x in zip(terms.tolist(), w.tolist(), strict=True):
            here = key[0] == t
            total[key[1][here]] += x * value[here]
        want = np.lexsort((np.arange(len(docs)), -total))[:10]
        want = want[total[want] > 0]
        assert best.ids.tolist() == want.tolist() and best.score.tolist() == total[want].tolist()
    assert sum(seen) < 0.6 * sum(30 * [len(docs)])


def test_ids_and_texts_as_columns(spark, cases):
    """The columns that byte-level encoding and the token files give beside their digests."""
    from trajectra.llm import bpe, tokenfile

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.with_decoded(bpe.with_ids(cases.where("doc_id <> 10"), path, pattern), path, pattern).collect()
    enc = bpe.encoding(path, pattern)
    assert all(r.ids == enc.encode_ordinary(r.text or "") and r.decoded == (r.text or "") for r in rows) and len(rows) > 5
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/ids"
    tokenfile.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), block_tokens=3000)
    got = {r.doc_id: r for r in tokenfile.read(spark, folder).collect()}
    for r in docs.collect():
        assert list(got[r.doc_id].ids) == [*enc.encode_ordinary(r.text or ""), 2] and got[r.doc_id].n_tokens == len(got[r.doc_id].ids)


def test_working_folders_go_when_told(spark, monkeypatch):
    import os

    from trajectra.llm.common import Scratch

    monkeypatch.setattr(Scratch, "made", set())  # other tests' folders stay
    one, two = Scratch(spark, "one"), Scratch(spark, "two")
    for s in (one, two):
        assert s.keep(spark.range(2), "rows").count() == 2
    path = lambda s: s.root.removeprefix("file://")
    one.close()
    assert not os.path.exists(path(one)) and os.path.isdir(path(two))
    Scratch.close_all(spark)
    assert not os.path.exists(path(two)) and not Scratch.made
