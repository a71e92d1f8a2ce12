"""Steps that many queries share: the same results with less work a task."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trajectra.functions import digests, metrics
from trajectra.operators import evaluation, graph, ordering, training, trajectory
from trajectra.plans import queries
from trajectra.sources import tables
from trajectra.sources.working import folder, working
from trajectra.streaming import events


def _lcs(p, g):
    row = [0] * (len(g) + 1)
    for x in p:
        now = [0]
        for j, y in enumerate(g):
            now.append(row[j] + 1 if x is not None and x == y else max(row[j + 1], now[j]))
        row = now
    return row[-1]


def test_lcs_of_bits_and_of_numbers(spark):
    """Lengths on both sides of the 62 names that a row of bits holds; without a common name the folds are not entered."""
    rng = random.Random(5)
    rows = [([rng.choice("abcdef") for _ in range(rng.randrange(9))], [rng.choice("abcdefgh") for _ in range(n)]) for n in (0, 1, 2, 5, 9, 30, 61, 62, 63, 70) for _ in range(6)]
    rows += [(["x", "y"], ["a", "b"]), (["a", None], [None, "a"]), ([], [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p array<string>, g array<string>")
    found = {r.i: r.n for r in df.select("i", metrics.lcs(F.col("p"), F.col("g")).alias("n")).collect()}
    assert found == {i: _lcs(p, g) for i, (p, g) in enumerate(rows)}


def test_disjoint_sequences_are_not_folded(spark):
    """Every fold over a pair of sequences stands behind a test whether they share a name."""
    p, g = F.col("p"), F.col("g")
    rows = spark.createDataFrame([(["a", "b"], ["c", "d"])], "p array<string>, g array<string>")
    for f in (metrics.lcs, metrics.ordered_precision, metrics.kendall_tau, metrics.transition_accuracy):
        assert "arrays_overlap" in f(p, g)._jc.toString()
    assert {n: rows.select(f(p, g).alias("x")).first().x for n, f in metrics.ALL_METRICS.items()} == dict.fromkeys(metrics.ALL_METRICS, 0)


def test_only_first_queries_carry_vectors(spark):
    """Tasks go by the number of their vector, so what is shuffled of a task does not hold it."""
    q = queries._queries(spark, "/root/testdata/sf0.001")
    assert q.where("(vec IS NOT NULL) <> (query_id = by_k)").count() == 0
    assert q.count() == q.select("query_id").distinct().count() and q.where("by_k < by_vec OR query_id < by_k").count() == 0


def test_digests_of_many_messages():
    """Heads and tails of different lengths, up to one block and beyond it."""
    for heads, tails in (([b"42:%d:" % c for c in range(0, 1200, 7)], [b"9", b"10", b"123456", b""]), ([b"x" * 40], [b"y" * 15]), ([b"x" * 41, b"z"], [b"y" * 15])):
        assert digests.md5(heads, tails).tobytes() == b"".join(hashlib.md5(h + t).digest() for t in tails for h in heads)


def test_random_orders_of_the_rows_that_they_change(spark):
    """Rows with fewer than two common names are counted, not shuffled; the means are those of shuffling all."""
    rows = [(i, "m", list(p), list(g)) for i, (p, g) in enumerate([("abc", "cab"), ("abcd", "dxc"), ("ab", "xy"), ("a", "a"), ("", "a"), ("aab", "ba")])]
    df = spark.createDataFrame(rows, "query_id long, method string, p array<string>, g array<string>")
    names = {"o": metrics.ordered_precision, "t": metrics.kendall_tau}
    got = {r.shuffle: (round(r.o, 9), round(r.t, 9)) for r in evaluation.random_order_means(df, names, 20).collect()}
    every = evaluation.random_orders(df, 20).select("shuffle", *[f(F.col("p"), F.col("g")).alias(n) for n, f in names.items()])
    want = {r.shuffle: (round(r.o, 9), round(r.t, 9)) for r in every.groupBy("shuffle").agg(F.avg("o").alias("o"), F.avg("t").alias("t")).collect()}
    assert got == want and len(got) == 20


def test_a_closed_stream_holds_nothing_back(spark):
    """The events of the last hour count once the stream has ended; nothing does in a stream without events."""
    source, close, sink = (folder(spark, n) for n in ("events", "stream-end", "stream"))
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=20 * i), 1, f"e{i}", 1.0, "{}") for i in range(5)]
    whole = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    whole.coalesce(1).write.parquet(source)
    events.end(spark, close)
    parts = events.transition_parts(events.read(spark, source, "*.parquet").unionByName(events.read(spark, close, "*.parquet")))
    assert events.drain(parts, sink).agg(F.sum("count").alias("n")).first().n == 1.0  # of the first two
    events.end(spark, close, whole)
    assert events.drain(parts, sink).agg(F.sum("count").alias("n")).first().n == 4 + 3 * 0.5
    events.end(spark, close, whole.limit(0))


def test_own_pairs_are_made_in_their_rows(spark):
    """Pairs of a task come from one row of its tools' features, so nothing is shuffled for them."""
    own = queries._own_features(spark, "/root/testdata/sf0.001")
    pairs = training.paired(own)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 2 * training.after_pairs(own).count() > 0


def test_search_holds_only_steps_that_may_be_settled():
    """The heap leaves out what costs more than a known path; the plans are those of a search that holds all."""
    import heapq

    from trajectra.operators import planning

    rng, names = random.Random(3), "abcdefghij"
    for _ in range(30):
        adjacency = {a: [(b, rng.choice((0.1, 0.2, 0.5, 0.9))) for b in names if b != a and rng.random() < 0.6] for a in names}
        sims = {a: rng.random() for a in names}
        heap, settled, pushed = [(0.0, ("a",))], {}, 1
        while heap:
            cost, path = heapq.heappop(heap)
            if path[-1] in settled:
                continue
            settled[path[-1]] = path
            if len(path) < 8 and not (len(path) >= 3 and max(sims[t] for t in path[-3:]) < 0.05):
                for to, w in adjacency[path[-1]]:
                    if to not in settled:
                        heapq.heappush(heap, (cost + 1 / (w + 1e-6) + 0.3 * (1 - sims[to]), (*path, to)))
        found = planning.search(adjacency, sims, ["a"], 4)
        mean = lambda p: sum(sims[t] for t in p) / len(p)
        lengths = {len(p) for p in settled.values()}
        want = next(n for n in (4, 5, 3, 6, 2, 7) if n in lengths) if lengths & {2, 3, 4, 5, 6, 7} else 1
        assert mean(found) == max(mean(p) for p in settled.values() if len(p) == want)


def test_sequences_are_brought_together_once(spark):
    """Transitions and positions of sequences are those of steps, with no other exchange than by what is counted."""
    rows = [(t, i, x) for t, seq in enumerate(["abcab", "a", "bb", "cacb", "abc"]) for i, x in enumerate(seq)]
    steps = spark.createDataFrame(rows, "task_id long, pos int, tool string")
    keep = working(spark, "test")
    seqs = keep(tables.sequences(steps), "seqs")
    for found, want in ((graph.transitions_of(seqs), graph.transitions(steps)), (trajectory.mean_positions_of(seqs), trajectory.mean_positions(steps))):
        key = [c for c, t in want.dtypes if t == "string"]
        assert found.orderBy(*key).collect() == want.orderBy(*key).collect()
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert queries._edges.__wrapped__(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Window") == 0


def test_categories_are_made_once_a_row(spark):
    """A fold over p does not make g's categories again: each array of categories is written once in the expression of a row."""
    df = spark.createDataFrame([(["a_for_x", "b_for_y"], ["c_for_y", "d_for_x", "e_for_y"])], "p array<string>, g array<string>")
    found = df.select(metrics.category_lcs_recall(F.col("p"), F.col("g")).alias("r"))
    assert found.first().r == pytest.approx(2 / 3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("substring_index") == 2


def _reads_of_queries(df):
    """How often a plan reads the table of all queries with their truths or keys."""
    return sum("Relation" in line and "by_k#" in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_alphas_come_to_the_queries_in_one_join(spark):
    d = "/root/testdata/sf0.001"
    found = queries._sweep.__wrapped__(spark, d)
    assert _reads_of_queries(found) == 1
    truths, got = queries._queries(spark, d).select("query_id", F.col("truth").alias("g")), {r.alpha: r.ordered_precision for r in found.collect()}
    for a in (0.0, 0.3, 1.0):  # each alpha by itself
        p = queries._ordered(spark, d, lambda rows, a=a: ordering.by_strongest(rows, a)).join(truths, "query_id")
        assert got[a] == pytest.approx(p.agg(F.avg(metrics.ordered_precision(F.col("seq"), F.col("g")))).first()[0])
    assert len(got) == 11


def test_deltas_need_no_other_method(spark, tmp_path):
    """Only the two methods and the metric that are compared are worked out, and they agree with the table of all."""
    (tmp_path / "sf").symlink_to("/root/testdata/sf0.001")
    d = str(tmp_path / "sf")
    found = sorted(map(tuple, queries.extreme_deltas(spark, d).collect()))
    assert not {k[2] for k in queries._kept if k[1] == d} & {"_measured", "_predictions"}
    of_all = evaluation.extremes(evaluation.paired(queries._measured(spark, d), "semantic_strongest", "frequency", "set_f1"))
    assert found and found == sorted(map(tuple, queries._six(of_all).collect()))


def test_plans_and_truths_are_not_broadcast(spark):
    """Plans with the settings that make them are small as files and large in memory, so they are merged with the truths."""
    found = queries._tuned.__wrapped__(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in found.splitlines() if "Join" in line and "[by_k#" in line]
    assert len(joins) >= 3 and all("SortMergeJoin" in line for line in joins)


def test_registered_folds_stand_behind_a_test():
    """The functions registered for SQL fold over sequences that share a name only, and their LCS is a row of bits, as the column functions'."""
    from trajectra.operators import registered

    for name in ("seq_jaccard", "seq_set_f1", "seq_lcs", "seq_lcs_recall", "seq_ordered_overlap", "seq_ordered_precision"):
        assert "arrays_overlap(p, g)" in registered.FUNCTIONS[name][1]


def test_registered_lcs_of_bits_and_of_numbers(spark):
    from trajectra.operators import registered

    rng = random.Random(6)
    rows = [([rng.choice("abcdef") for _ in range(rng.randrange(9))], [rng.choice("abcdefgh") for _ in range(n)]) for n in (0, 1, 5, 30, 61, 62, 63, 70) for _ in range(4)]
    rows += [(["x", "y"], ["a", "b"]), (["a", None], [None, "a"]), ([], [])]
    registered.register(spark)
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p array<string>, g array<string>").createOrReplaceTempView("some_sequences")
    found = {r.i: r.n for r in spark.sql("SELECT i, seq_lcs(p, g) AS n FROM some_sequences").collect()}
    assert found == {i: _lcs(p, g) for i, (p, g) in enumerate(rows)}


def test_greedy_choices_are_made_once_a_vector(spark):
    """A query of any k takes the first of its vector's longest choice, which is what it would get by itself."""
    from trajectra.operators import planning

    d = "/root/testdata/sf0.001"
    found, q = queries.select_hybrid_greedy(spark, d), queries._queries(spark, d)
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    alone = planning.steps_of(planning.select_greedy(q.where("query_id = by_k"), queries._vectors(spark, d), queries._tp(spark, d)))
    want = q.select("query_id", "by_k").join(alone.withColumnRenamed("query_id", "by_k"), "by_k").select("query_id", "step", "tool")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []


def test_own_pairs_without_a_shuffle(spark):
    """Pairs that look up links and vectors in arrays are those that are joined, to six decimals; nothing is shuffled for them."""
    d = "/root/testdata/sf0.001"
    found = queries.pair_training_rows(spark, d)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = queries._six(training.paired(queries._own_features(spark, d)))
    assert found.dtypes == want.dtypes
    rows = lambda df: sorted((*r[:4], *(round(x, 5) + 0.0 for x in r[4:])) for r in map(tuple, df.collect()))
    assert rows(found) == rows(want) != []


def test_a_graph_too_large_for_a_task_is_joined(spark, monkeypatch):
    from trajectra.operators import own

    d = "/root/testdata/sf0.001"
    asked = queries._queries(spark, d).where("query_id = by_vec").select("query_id", "vec")
    assert own.lookup(queries._vectors(spark, d), queries._tp(spark, d), queries._positions(spark, d), asked, most=10) is None
    want = queries.pair_training_rows(spark, d).count()
    monkeypatch.setattr(queries, "_looked_up", lambda spark, d: None)
    assert queries.pair_training_rows(spark, d).count() == want


def test_blocks_of_own_pairs(spark):
    """Blocks hold the training tasks' pairs, in single precision, whatever the runs of tasks; a net of them is as good as one of pairs."""
    from trajectra.operators import own

    d = "/root/testdata/sf0.001"
    look, tasks = queries._looked_up(spark, d), queries._of_part(spark, d, False)
    kept = own.blocks(tasks, look, working(spark, "test"), size=100, batches=4)
    assert "PartitionFilters: [isnotnull(batch" in kept.where("batch = 1")._jdf.queryExecution().executedPlan().toString()
    blocks = kept.collect()
    pairs = training.after_pairs(queries._own_features(spark, d).where("NOT is_test"))
    assert sum(len(b.label) for b in blocks) == 2 * pairs.count() and {b.part for b in blocks} == {"train", "val"}
    assert all(len(b.x) == 4 * 8 * len(b.label) // 2 and sum(b.label) * 2 == len(b.label) for b in blocks)
    old = training.pair_net(pairs, working(spark, "test"), epochs=3, batches=2, rate=1e-2, turned=True)
    new = own.net(tasks, look, working(spark, "test"), epochs=3, batches=2, rate=1e-2)
    assert new.history[-1]["val_loss"] == pytest.approx(old.history[-1]["val_loss"], abs=0.02)
