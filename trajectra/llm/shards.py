"""Sharding by a keyed permutation of global row numbers, in DataFrame operations only.

Rows are numbered 0..n-1 in the order of (doc_id, size, crc32, xxhash64). A Feistel network whose
halves count a = ceil(sqrt(n)) and b = ceil(n / a) permutes [0, a*b); a number that leaves [0, n)
walks on until it returns, which makes a permutation of [0, n). Shard is the permuted number modulo
the count of shards and slot the quotient, so shard counts differ by one at most and slots have no
gaps. Where a row lands follows from its number, n, the key and the count of shards alone.

Edge cases: a null text has size 1 and crc32 0; a null doc_id comes first; rows that agree in all
four sort columns can't be told apart and take neighbouring numbers in either order; texts of any length are
measured whole, and do not travel with their rows; only doc_id and the text are looked at, whatever other columns are
named; an empty table returns no rows.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 8
#: Keys of the rounds.
KEY = (0x2545F491, 0x5851F42D, 0x14057B7E, 0x369DEA0F)
PRIME = 2**31 - 1


def halves(n: int) -> tuple[int, int]:
    """Sizes a and b of the two halves; a * b exceeds n by less than a."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def permute(row: F.Column, n: int, key: tuple[int, ...] = KEY) -> F.Column:
    """The place of each row number among n."""
    a, b = halves(n)

    def mixed(x: F.Column, k: int, modulus: int) -> F.Column:
        once = (x % PRIME + k % PRIME) % PRIME
        twice = (once * once + k % 65537) % PRIME
        return (twice * (twice % 1048573 + 1) + once) % PRIME % modulus

    def round_of(i: int, k: int):
        if i % 2 == 0:
            return lambda s: F.struct(((s["u"] + mixed(s["l"], k, a)) % a).alias("u"), s["l"].alias("l"))
        return lambda s: F.struct(s["u"].alias("u"), ((s["l"] + mixed(s["u"], k, b)) % b).alias("l"))

    rounds = F.array(*[F.lit(i) for i in range(len(key))])

    def network(x: F.Column) -> F.Column:
        def one(s, i):
            out = round_of(len(key) - 1, key[-1])(s)
            for j in reversed(range(len(key) - 1)):
                out = F.when(i == j, round_of(j, key[j])(s)).otherwise(out)
            return out

        start = F.struct(((x - x % b) / b).cast("long").alias("u"), (x % b).alias("l"))
        return F.aggregate(rounds, start, one, lambda s: s["u"] * b + s["l"])

    # a walk meets only numbers outside [0, n), each once: fewer than a * b - n + 2 steps in all;
    # beyond 64 steps, the chance of being outside is below (1 / sqrt(n)) ** 64
    first = network(row)
    steps = min(a * b - n, 64)
    if steps <= 0:
        return first
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda x, _: F.when(x < n, x).otherwise(network(x)))
    done = F.when(first < n, first).otherwise(walked)
    return F.when(done < n, done).otherwise(F.raise_error(F.lit("the walk did not return: choose another key")).cast("long"))


def numbered(docs: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32, row) with global row numbers, and the count of rows.

    One shuffle of three narrow columns; texts stay where they are. The sorted ranges are written
    once, so that their row positions hold whatever is recomputed later.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    narrow = docs.select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("_tie"),
    )
    keys = ["doc_id", "size", "text_crc32", "_tie"]
    kept = scratch.keep(
        narrow.repartitionByRange(common.partitions(spark), *keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranges",
    )
    part, inside = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rows = kept.withColumn("_part", part).join(F.broadcast(before), "_part")  # one row a partition
    n = kept.count()
    return rows.select("doc_id", "size", "text_crc32", (F.col("_before") + inside).alias("row")), n


def assign(docs: DataFrame, shards: int = SHARDS, key: tuple[int, ...] = KEY) -> DataFrame:
    """Every document with its shard and slot, under the law `rows`."""
    rows, n = numbered(docs, common.Scratch(docs.sparkSession, "shards"))
    place = permute(F.col("row"), n, key)
    return rows.withColumn("_p", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"),
        ((F.col("_p") - F.col("_p") % shards) / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
