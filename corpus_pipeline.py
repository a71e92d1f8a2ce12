"""Corpus preparation in five stages, each of which reads what the one before it wrote.

Every stage takes (spark, docs, sf_dir). The first four return the columns of `documents`:

1. quality_classifier: documents whose score is below the threshold go.
2. line_dedup: boilerplate lines of a source go from its texts; n_chars follows; no document goes.
3. jaccard_join: of each group of near-duplicates the document with the smallest doc_id stays;
   texts without words are in no group and stay.
4. decontamination: documents that hold a window of a benchmark item go.
5. byte_bpe: what is left, encoded and decoded.

Edge cases: a null text counts as empty and stays null; empty texts are scored like others, and those that stay have no
lines, no near-duplicates and no windows; rows with equal doc_id are separate documents, and rows that repeat doc_id and
text are near-duplicates of each other; texts of any length go through whole; columns of the input that are named as an operator's
own pass through unchanged; an empty table gives empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajectra.llm import bpe, common, contamination, lines, quality, setjoin


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    forest = quality.train(docs, common.table(spark, sf_dir, "labels"))
    score = common.fresh(docs, "score")
    return quality.score(docs, forest, out=score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # under names that no column of the input has
    own = {c: common.fresh(docs, f"own_{c}") for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = lines.dedup(docs.withColumnsRenamed(own))
    changed = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "near-duplicates")
    found = scratch.keep(setjoin.join(docs), "found")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "node")
    some, none = found.where("n_shingles > 0"), found.where("n_shingles = 0")
    least = some.groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.node")
    keep = scratch.keep(least.unionByName(none.select("doc_id", "node").distinct()), "keep")
    key, doc = common.fresh(docs, "key"), common.fresh(docs, "doc")
    same = lambda other: (F.col(key) == F.col("_of.node")) & F.col(doc).eqNullSafe(F.col("_of.doc_id"))
    rows = docs.withColumns({key: common.text_key(), doc: F.col("doc_id")})
    rows = rows.join(keep.select(F.struct("*").alias("_of")), same(keep), "left_semi")
    # rows that repeat both doc_id and text are copies, too; there are rarely any
    twice = scratch.keep(some.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
    if twice.limit(1).count():
        of = twice.select(F.struct("*").alias("_of"))
        nth = F.row_number().over(Window.partitionBy(key, doc).orderBy("source", "lang", "n_chars"))
        again, n = rows.join(of, same(of), "left_semi"), common.fresh(docs, "nth")
        rows = rows.join(of, same(of), "left_anti").unionByName(again.withColumn(n, nth).where(F.col(n) == 1).drop(n))
    return rows.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = common.fresh(docs, "key")
    rows = docs.withColumn(key, common.text_key())
    hits = contamination.decontaminate(rows.select(F.col(key).alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    # written, so that Spark knows the size by which it chooses how to join
    bad = common.Scratch(spark, "contaminated").keep(hits.where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct(), "bad")
    return rows.join(bad, key, "left_anti").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the trained classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
