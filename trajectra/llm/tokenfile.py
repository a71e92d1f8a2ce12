"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

A block holds whole documents. Its ids are replaced by their ranks in the block's own table of
ids by falling frequency (ties: smaller id first), and every rank takes one to four bytes; two
bits a rank, packed four to a control byte apart from the data, tell how many. Decoding looks a
control byte up in a table of lengths and gathers the data bytes with numpy.

Layout of a block, little-endian: magic, documents, tokens, table entries (4 x uint32); ids by
rank (uint32); doc_ids (int64); validity of doc_ids (uint8); tokens of each document (uint32);
control bytes; data bytes. Blocks are rows of a Parquet table, so that any store Spark writes to
can hold them. A block's table counts all of its tokens; no pass over the corpus comes before.

Edge cases: a null text counts as empty and gets the end id alone; a null doc_id is kept and
comes first; rows with equal doc_id follow one another in the order of their texts; a very long text
makes a block of its own; only doc_id and text are looked at, whatever other columns are named; an
empty table makes no block and reads back as no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import PieceEncoder

END_ID = 2
#: A block is closed at so many tokens; a longer document makes a block of its own.
BLOCK_TOKENS = 1_000_000
_MAGIC = 0x31544B54
#: Ids below this are counted without sorting them.
_DENSE = 1 << 22
#: Bytes of the four ranks of each control byte, and their sum.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
_BLOCK = "part int, block int, first_token long, n_tokens long, payload binary"


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The rank table and the control and data bytes of ids."""
    top = int(ids.max(initial=0))
    if top < _DENSE:  # counted in an array of all ids; else by sorting
        counts = np.bincount(ids, minlength=top + 1)
        found = np.flatnonzero(counts)
        counts = counts[found]
    else:
        found, counts = np.unique(ids, return_counts=True)
    order = np.lexsort((found, -counts))
    rank = np.empty(len(found), np.uint32)
    rank[order] = np.arange(len(found), dtype=np.uint32)
    if top < _DENSE:
        of = np.zeros(top + 1, np.uint32)
        of[found] = rank
        codes = of[ids]
    else:
        codes = rank[np.searchsorted(found, ids)]
    size = (1 + (codes > 0xFF) + (codes > 0xFFFF) + (codes > 0xFFFFFF)).astype(np.uint8)
    bits = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    bits[: len(codes)] = size - 1
    control = (bits.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    ends = np.cumsum(size, dtype=np.int64)
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        some = np.flatnonzero(size > k)
        data[ends[some] - size[some] + k] = codes[some] >> np.uint32(8 * k)
    return found[order].astype("<u4"), control.tobytes() + data.tobytes()


def decode_ids(table: np.ndarray, coded: bytes, n: int) -> np.ndarray:
    """The n ids that encode_ids coded."""
    quads = -(-n // 4)
    raw = np.frombuffer(coded, np.uint8)
    size = _LENGTHS[raw[:quads]].ravel()[:n]
    at = np.cumsum(size) - size
    data = np.concatenate([raw[quads:], np.zeros(4, np.uint8)])
    ranks = np.zeros(n, np.uint32)
    for k in range(4):
        ranks |= np.where(size > k, data[np.minimum(at + k, len(data) - 1)], 0).astype(np.uint32) << np.uint32(8 * k)
    return table[ranks]


def pack(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """One block."""
    ids = np.concatenate(docs).astype(np.uint32) if docs else np.empty(0, np.uint32)
    table, coded = encode_ids(ids)
    return b"".join([
        np.array([_MAGIC, len(docs), len(ids), len(table)], "<u4").tobytes(), table.tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is not None for x in doc_ids], np.uint8).tobytes(),
        np.array([len(x) for x in docs], "<u4").tobytes(), coded,
    ])


def unpack(block: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """The doc_ids and ids of a block."""
    magic, n, tokens, entries = (int(x) for x in np.frombuffer(block, "<u4", 4))
    if magic != _MAGIC:
        raise ValueError("this is no block of token ids")
    at = 16
    table = np.frombuffer(block, "<u4", entries, at)
    doc_ids = np.frombuffer(block, "<i8", n, at := at + 4 * entries)
    there = np.frombuffer(block, np.uint8, n, at := at + 8 * n)
    sizes = np.frombuffer(block, "<u4", n, at := at + n).astype(np.int64)
    ids = decode_ids(table, block[at + 4 * n :], tokens)
    ends = np.cumsum(sizes)
    return [int(d) if ok else None for d, ok in zip(doc_ids, there, strict=True)], [
        ids[e - s : e] for e, s in zip(ends, sizes, strict=True)
    ]


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every text and write the blocks in ascending doc_id order.

    One shuffle deals documents by ranges of doc_id and the first characters of the text, so that one id, or none at
    all, may have any number of them; ranges are found on a sample of these short keys, and each is encoded as it
    streams by.
    """
    ordered = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(max(common.partitions(docs.sparkSession), 1), "doc_id", F.substring("text", 1, 32))
        .sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    )

    @common.lean
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, at, first, ids, held, kept = PieceEncoder.load(tokenizer_path), 0, 0, [], [], 0
        end, part = np.array([end_id], np.uint32), 0
        for batch in batches:
            for doc_id, coded, part in zip(batch["doc_id"].astype(object), encoder.stream(batch["text"]), batch["part"], strict=True):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                held.append(np.concatenate([coded, end]))
                kept += len(held[-1])
                if kept >= block_tokens:
                    yield pd.DataFrame([(int(part), at, first, kept, pack(ids, held))], columns=_names)
                    at, first, ids, held, kept = at + 1, first + kept, [], [], 0
        if held:
            yield pd.DataFrame([(int(part), at, first, kept, pack(ids, held))], columns=_names)

    _names = ["part", "block", "first_token", "n_tokens", "payload"]
    ordered.mapInPandas(blocks, _BLOCK).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, ids.

    Offsets of the ranges come from one sum a range, a table as short as the list of files.
    """
    return _from_files(spark, path, "doc_id long, start long, n_tokens long, ids array<int>", lambda d, s, x: (d, s, len(x), x.astype(np.int32)))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the crc32 of its ids."""
    return _from_files(
        spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long",
        lambda d, s, x: (d, s, len(x), zlib.crc32(x.astype("<u4").tobytes())),
    )


def _from_files(spark: SparkSession, path: str, schema: str, row) -> DataFrame:
    blocks = spark.read.schema(_BLOCK).parquet(path)
    from pyspark.sql import Window

    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = sums.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("before"))
    names = [x.split()[0] for x in schema.split(", ")]

    @common.lean
    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, payload in zip(batch["first"], batch["payload"], strict=True):
                rows, at = [], int(first)
                for doc_id, ids in zip(*unpack(payload), strict=True):
                    rows.append(row(doc_id, at, ids))
                    at += len(ids)
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"doc_id": "Int64"})

    # one row a range: as many as the shuffle had partitions
    return (
        blocks.join(F.broadcast(before), "part")
        .select((F.col("before") + F.col("first_token")).alias("first"), "payload")
        .mapInPandas(opened, schema)
    )
