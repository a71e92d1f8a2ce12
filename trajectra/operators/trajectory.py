"""Trajectories from chats and logs, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def from_chats(chats: DataFrame) -> DataFrame:
    """Chats (id, conversations: array<struct<from, value>>) as trajectories, with a success flag.

    The tool list comes from the system turn, a call from each assistant turn with an action other
    than Finish, its success from the turn after it. Calls that failed are kept.
    """
    turns = F.col("conversations")
    said = lambda role: F.filter(turns, lambda t: t["from"] == role)
    tools = text.tool_list(F.get(said("system"), F.lit(0))["value"])
    calls = F.filter(
        F.transform(
            turns,
            lambda t, i: F.struct(
                F.when(t["from"] == "assistant", text.action_name(t["value"])).alias("name"),
                text.call_succeeded(F.get(turns, i + 1)["value"]).alias("call_success"),
            ),
        ),
        lambda c: c["name"].isNotNull(),
    )
    rows = chats.select(
        F.col("id").alias("task_id"), text.task_text(F.get(said("user"), F.lit(0))["value"]).alias("task_description"),
        tools.alias("_tools"), calls.alias("_calls"),
        text.trajectory_succeeded(F.transform(said("assistant"), lambda t: t["value"])).alias("succeeded"),
    )
    described = F.transform(
        "_calls",
        lambda c: F.struct(
            c["name"].alias("name"), text.category(c["name"], F.lit("")).alias("category"),
            F.coalesce(F.element_at(F.filter(F.concat(F.array(F.struct(c["name"].alias("name"), F.lit("").alias("description"))), "_tools"), lambda t: t["name"] == c["name"]), -1)["description"], F.lit("")).alias("description"),
            c["call_success"].alias("call_success"),
        ),
    )
    return rows.select(
        "task_id", "task_description", F.transform("_calls", lambda c: c["name"]).alias("tool_sequence"),
        described.alias("tool_details"), F.size("_calls").alias("num_steps"), "succeeded",
    )


def successful(trajectories: DataFrame) -> DataFrame:
    """Those that succeeded and hold a call."""
    return trajectories.where(F.col("succeeded") & (F.col("num_steps") > 0))


def from_answers(answers: DataFrame) -> DataFrame:
    """Answer files (answer_generation, task_id) as trajectories: valid answers only, runs of a tool once."""
    a = F.col("answer_generation")
    names = text.collapsed(F.transform(a["function"], lambda f: f["name"]))
    rows = answers.where(a["valid_data"] & (a["finish_type"] == "give_answer") & (F.trim(a["query"]) != ""))
    return rows.select(
        "task_id", a["query"].alias("task_description"), F.filter(names, lambda n: n != "Finish").alias("tool_sequence")
    ).withColumn("num_steps", F.size("tool_sequence")).where("num_steps > 0")


def from_api_log(log: DataFrame) -> DataFrame:
    """A per-step log (ord, input, output) as trajectories: one task a request, steps in log order."""
    rows = log.select("ord", text.log_query(F.col("input")).alias("task_description"), text.api_name(F.col("output")).alias("tool"))
    found = (
        rows.where("task_description IS NOT NULL AND tool IS NOT NULL").groupBy("task_description")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "tool"))).alias("_s"), F.min("ord").alias("ord"))
    )
    seq = text.collapsed(F.transform("_s", lambda x: x["tool"]))
    return found.select("ord", "task_description", seq.alias("tool_sequence")).withColumn("num_steps", F.size("tool_sequence"))


def from_api_traces(traces: DataFrame, finder: str = "ToolSearcher") -> DataFrame:
    """API traces (requirement, apis: array<struct<api_name, output>>) as trajectories without the finder's calls.

    Descriptions are those that the finder returned; a name that it never described is spelled out.
    """
    apis = F.col("apis")
    found = F.flatten(F.transform(F.filter(apis, lambda a: a["api_name"] == finder), lambda a: text.described_apis(a["output"])))
    names = F.transform(F.filter(apis, lambda a: a["api_name"] != finder), lambda a: a["api_name"])
    rows = traces.select(F.col("requirement").alias("task_description"), names.alias("tool_sequence"), found.alias("_found"))
    details = F.transform(
        "tool_sequence",
        lambda n: F.struct(
            n.alias("name"),
            F.coalesce(F.get(F.filter("_found", lambda f: f["name"] == n), F.lit(0))["description"], F.replace(n, F.lit("_"), F.lit(" "))).alias("description"),
        ),
    )
    return rows.select("task_description", "tool_sequence", details.alias("tool_details"), F.size("tool_sequence").alias("num_steps")).where("num_steps > 0")


def first_of_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def tool_frequency(steps: DataFrame) -> DataFrame:
    """(tool, category, frequency) over all steps."""
    return steps.groupBy("tool", "category").agg(F.count(F.lit(1)).alias("frequency"))


def registry(details: DataFrame, order: list[str]) -> DataFrame:
    """(tool, category, description, frequency): the first category and description that aren't empty."""
    at = F.struct(*order)
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", at))
    return details.groupBy("tool").agg(
        F.coalesce(first("category"), F.lit("")).alias("category"), F.coalesce(first("description"), F.lit("")).alias("description"),
        F.count(F.lit(1)).alias("frequency"),
    )


def length_stats(seqs: DataFrame) -> DataFrame:
    """By length bucket: tasks, mean, median, upper median, least and greatest length."""
    b = seqs.withColumn("bucket", text.length_bucket(F.col("num_steps")))
    return b.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg("num_steps").alias("mean_len"), F.percentile("num_steps", F.lit(0.5)).alias("median_len"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY num_steps DESC)").cast("double").alias("upper_median_len"),
        F.min("num_steps").alias("min_len"), F.max("num_steps").alias("max_len"),
    )


def length_histogram(seqs: DataFrame, most: int = 50) -> DataFrame:
    """Tasks by length, longer ones with the last bin."""
    return seqs.groupBy(F.least("num_steps", F.lit(most)).alias("num_steps")).agg(F.count(F.lit(1)).alias("n"))


def split(seqs: DataFrame, share: float = 0.2, seed: str = "42") -> DataFrame:
    """Adds bucket and is_test: in each length bucket, max(1, floor(share * n)) tasks by a hash of their id."""
    b = seqs.withColumn("bucket", text.length_bucket(F.col("num_steps")))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("task_id").cast("string")))
    sizes = b.groupBy("bucket").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).alias("_t"))
    # the cut of each bucket is its _t-th smallest hash; no bucket is sorted in one task
    cut = _smallest(b.select("bucket", h.alias("_h")), sizes)
    return b.withColumn("_h", h).join(cut, "bucket").withColumn("is_test", F.col("_h") <= F.col("_cut")).drop("_h", "_cut")


def _smallest(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(bucket, _cut): the _t-th smallest _h of each bucket, by counts of prefixes, then of what is left."""
    p = rows.withColumn("_p", F.substring("_h", 1, 3))
    counts = p.groupBy("bucket", "_p").agg(F.count(F.lit(1)).alias("_n")).join(sizes, "bucket")
    w = Window.partitionBy("bucket").orderBy("_p")
    sums = counts.withColumn("_sum", F.sum("_n").over(w))
    at = sums.where((F.col("_sum") >= F.col("_t")) & (F.col("_sum") - F.col("_n") < F.col("_t"))).select(
        "bucket", "_p", (F.col("_t") - F.col("_sum") + F.col("_n")).alias("_k")
    )
    inside = p.join(at, ["bucket", "_p"]).withColumn("_r", F.row_number().over(Window.partitionBy("bucket", "_p").orderBy("_h")))
    return inside.where("_r = _k").select("bucket", F.col("_h").alias("_cut"))


def coverage(new: DataFrame, known: DataFrame) -> DataFrame:
    """One row: tools of `new`, how many of them `known` has, the rest, and the share in percent."""
    a, b = new.select("tool").distinct(), known.select("tool").distinct().withColumn("_in", F.lit(1))
    return a.join(b, "tool", "left").agg(
        F.count(F.lit(1)).alias("n_tools"), F.count("_in").alias("covered"), (F.count(F.lit(1)) - F.count("_in")).alias("uncovered"),
        F.coalesce(100.0 * F.try_divide(F.count("_in"), F.count(F.lit(1))), F.lit(0.0)).alias("pct"),
    )


def uncovered(new: DataFrame, known: DataFrame, n: int = 10) -> DataFrame:
    """(place, tool, n_tasks): the first n tools by name of `new` that `known` lacks, and in how many tasks they are."""
    rows = new.select("task_id", "tool").distinct().join(known.select("tool").distinct(), "tool", "left_anti")
    top = rows.groupBy("tool").agg(F.count(F.lit(1)).alias("n_tasks")).orderBy("tool").limit(n)
    return top.select((F.row_number().over(Window.orderBy("tool")) - 1).alias("place"), "tool", "n_tasks")  # n rows


def overlap(test: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Test rows whose key occurs in training, and those that are left without them."""
    seen = train.select(key).distinct()
    return test.join(seen, key, "left_semi").select(F.lit("seen").alias("part"), key).unionByName(
        test.join(seen, key, "left_anti").select(F.lit("new").alias("part"), key)
    )


def mean_positions(steps: DataFrame) -> DataFrame:
    """(tool, avg_pos, n): the mean of pos / length."""
    sized = steps.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("task_id")))
    return sized.groupBy("tool").agg(F.avg(F.col("pos") / F.col("_n")).alias("avg_pos"), F.count(F.lit(1)).alias("n"))


def mean_positions_of(seqs: DataFrame) -> DataFrame:
    """The same of sequences (seq, num_steps), which no task has to bring together again."""
    steps = seqs.select("num_steps", F.posexplode("seq").alias("pos", "tool"))
    return steps.groupBy("tool").agg(F.avg(F.col("pos") / F.col("num_steps")).alias("avg_pos"), F.count(F.lit(1)).alias("n"))


def lookahead(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, next_role, next_len): every turn with the one after it; length 0 without one."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select(
        "conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"), F.coalesce(F.char_length(F.lead("text").over(w)), F.lit(0)).alias("next_len")
    )


def similar_examples(targets: DataFrame, pool: DataFrame, size: int = 3, within: int = 1, seed: str = "42") -> DataFrame:
    """(task_id, place, example): `size` different tasks of the pool (fewer, if it has fewer) for each target.

    They come from those whose num_steps differs by at most `within`; if there are none, from the whole pool. The pool is
    numbered by length and a hash, so those of neighbouring lengths are a range of numbers, and no task numbers a whole length.
    """
    cell = F.substring(F.md5(F.col("task_id").cast("string")), 1, 2)
    p = pool.select(F.col("task_id").alias("example"), F.col("num_steps").alias("_len"), cell.alias("_cell"))
    sizes = p.groupBy("_len", "_cell").agg(F.count(F.lit(1)).alias("_n"))  # 256 rows a length
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_len", "_cell")) - F.col("_n"))
    nth = F.row_number().over(Window.partitionBy("_len", "_cell").orderBy("example")) - 1
    numbered = p.withColumn("_nth", nth).join(starts, ["_len", "_cell"]).select("example", (F.col("_start") + F.col("_nth")).alias("_i"))
    lengths = starts.groupBy("_len").agg(F.min("_start").alias("_from"), F.sum("_n").alias("_n"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))  # one row
    near = targets.select("num_steps").distinct().withColumn("_len", F.explode(F.sequence(F.col("num_steps") - within, F.col("num_steps") + within)))
    span = near.join(lengths, "_len").groupBy("num_steps").agg(F.min("_from").alias("_from"), F.sum("_n").alias("_n"))
    t = targets.select("task_id", "num_steps").join(span, "num_steps", "left").crossJoin(total)
    t = t.select("task_id", F.coalesce("_from", F.lit(0)).alias("_from"), F.coalesce("_n", "_total").alias("_n")).where("_n > 0")
    first = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("task_id").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("_n")
    drawn = t.withColumn("_first", first).withColumn("place", F.explode(F.sequence(F.lit(0), (F.least(F.lit(size), "_n") - 1).cast("int"))))
    drawn = drawn.withColumn("_i", F.col("_from") + (F.col("_first") + F.col("place")) % F.col("_n"))
    return drawn.join(numbered, "_i").select("task_id", "place", "example")
