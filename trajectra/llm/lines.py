"""Line dedup by site-relative frequency, in DataFrame operations only.

Documents are pages of a host (their `source`, or the host of their URL). For every line the share
of the host's pages that contain it is taken; a line whose share exceeds `ratio` on at least
`least` pages is boilerplate of that host and is dropped from all of its pages.

Lines are told apart by 64-bit hashes of their text after trimming; blank lines are never
boilerplate. Only (host, hash) counts are shuffled, summed before the exchange; a page holds a line
once however often it repeats it. A host has fewer than (mean lines a page) / ratio boilerplate
lines, so they fit an array that is joined back to the host's pages. Hosts with more than
1 / PARTS of all pages, of which there are fewer than PARTS, are dealt to several tasks by a salt.

Edge cases: a null host is a host of its own; a null text stays null and has no lines, an empty one
has one blank line; hosts of fewer than `least` pages keep everything; repeated rows count as pages
each; a share of exactly `ratio` is kept; texts of any length are split whole; columns of the input
named n_lines or n_dropped are replaced, all others stay as they are; an empty table returns no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RATIO = 0.08
LEAST = 4
#: Shares of all pages that one task should have of a host.
PARTS = 256


def _hash(line: F.Column) -> F.Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(_host, _line), the hash of each boilerplate line of a host, and (_host, _pages), the count of its pages."""
    scratch = common.Scratch(docs.sparkSession, "lines")
    pages = docs.select(F.struct(F.col(host).alias("h")).alias("_host"), F.col(text).alias("_text"))
    totals = scratch.keep(pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages")), "totals")
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.trim(x) != "")
    once = F.array_distinct(F.transform(lines, _hash))
    counts = (
        pages.select("_host", F.explode(once).alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= least)
    )
    return scratch.keep(counts.join(totals, "_host").where(F.col("_n") > F.col("_pages") * ratio).select("_host", "_line"), "drop"), totals


def dedup(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """All documents, their text without boilerplate lines, and the columns n_lines and n_dropped."""
    found, totals = boilerplate(docs, host, text, ratio, least)
    drop = found.groupBy("_host").agg(F.collect_list("_line").alias("_drop"))
    total = totals.agg(F.sum("_pages")).first()[0] or 0
    # fewer than PARTS rows, so they may be broadcast
    hot = totals.where(F.col("_pages") * PARTS > total).select("_host", F.ceil(F.col("_pages") * PARTS / max(total, 1)).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    drop = drop.join(F.broadcast(hot), "_host", "left").select("_host", "_drop", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    rows = docs.select(F.struct("*").alias("_row"), F.struct(F.col(host).alias("h")).alias("_host"), F.col(text).alias("_text"))
    plain = [F.col("_row").getField(c) for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rows = rows.join(F.broadcast(hot), "_host", "left").withColumn("_salt", F.pmod(F.xxhash64(*plain), salts).cast("int"))
    rows = rows.join(drop, ["_host", "_salt"], "left")
    lines = F.split("_text", "\n", -1)
    kept = F.filter(lines, lambda x: ~((F.trim(x) != "") & F.array_contains("_drop", _hash(x))))
    rows = rows.select("_row", "_text", F.coalesce(F.size(lines), F.lit(0)).alias("_n"), F.when(F.col("_drop").isNotNull(), kept).alias("_kept"))
    n = F.when(F.col("_text").isNull(), 0).otherwise(F.col("_n"))
    n_dropped = F.when(F.col("_text").isNull() | F.col("_kept").isNull(), 0).otherwise(F.col("_n") - F.size("_kept"))
    out = F.when(n_dropped == 0, F.col("_text")).otherwise(F.array_join("_kept", "\n"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(
        *[(out if c == text else F.col("_row").getField(c)).alias(c) for c in own], n.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped")
    )
