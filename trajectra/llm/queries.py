"""The corpus operators applied to their tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contamination, html, lines, middle, neighbours, passages, quality, ranked, setjoin, shards, tokencount, tokenfile
from .common import Scratch, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, forest).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    path = f"{scratch.root}/blocks"
    tokenfile.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.digest(spark, path)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        contamination.digest_items(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.dedup(docs)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.transform(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_token_files, op3_nearest_neighbours, op4_sharding, op5_jaccard_join,
        op6_repeated_passages, op7_decontamination, op8_byte_bpe, op9_line_dedup, op10_html_extraction, op11_fill_in_middle, op12_token_counts,
        op13_ranked_search,
    )
}

ORACLE_SQL = {
    "op9_line_dedup": r"""
WITH pages AS (SELECT rowid AS r, doc_id, source, text, string_split(text, chr(10)) AS ls
               FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
ones AS (SELECT DISTINCT r, source, trim(l, ' ') AS line FROM (SELECT r, source, unnest(ls) AS l FROM pages)),
counts AS (SELECT source, line, count(*) AS n FROM ones WHERE line <> '' GROUP BY source, line),
drops AS (SELECT c.source, list(c.line) AS d FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
          WHERE c.n >= 4 AND c.n > t.pages * 0.08::DOUBLE GROUP BY c.source),
kept AS (SELECT p.*, list_filter(p.ls, lambda x: NOT list_contains(coalesce(d.d, []), trim(x, ' '))) AS ks
         FROM pages p LEFT JOIN drops d ON p.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, source,
       CASE WHEN text IS NULL THEN NULL ELSE array_to_string(ks, chr(10)) END AS text,
       coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(ks), 0)::BIGINT AS n_dropped
FROM kept""",
    "op11_fill_in_middle": r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
                   ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM cut),
ends AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN n = 0 OR h3 % 100 >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                     WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM ends)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts""",
    "op13_ranked_search": r"""
WITH terms AS (SELECT row_number() OVER () AS d, doc_id,
                      regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
total AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_words FROM terms WHERE len(ts) > 0),
places AS (SELECT d, any_value(doc_id) AS doc_id, any_value(len(ts)) AS n, term, count(*) AS tf FROM (SELECT *, unnest(ts) AS term FROM terms) GROUP BY d, term),
rarity AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM places, total GROUP BY term),
asked AS (SELECT i, any_value(item_id) AS item_id, term, count(*) AS times
          FROM (SELECT row_number() OVER () AS i, item_id,
                       unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY i, term),
scored AS (SELECT i, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
                  sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words))))::BIGINT AS score
           FROM asked JOIN rarity USING (term) JOIN places USING (term), total GROUP BY i, d),
best AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM best WHERE rank <= 10""",
}
