"""Byte-level BPE encoding and decoding by the tiktoken library and a local rank file.

Long texts are cut, every `chunk` characters or more, before a single blank between two
characters that are no white space; no match of the pattern crosses such a place, so the ids are
those of the whole text. A stretch without such a place is encoded whole. Decoding joins the raw
bytes of the ids.

Edge cases: a null text counts as empty (no ids, digests of no bytes); repeated rows are encoded
alike, rows with equal doc_id are separate documents; very long texts are encoded in parts and
whole; only doc_id and the text are looked at, whatever other columns are named; an empty table
returns no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters after which a text is cut at the next safe place.
CHUNK = 20_000
_SAFE = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str):
    """The tiktoken encoding of a rank file; read once a worker."""
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """The text in parts of `size` characters or a little more, cut at safe places only."""
    out, at = [], 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def encode(text: str | None, rank_path: str, pattern: str, size: int = CHUNK) -> list[int]:
    """The ids of a whole text."""
    enc = encoding(rank_path, pattern)
    return [i for part in chunks(text or "", size) for i in enc.encode_ordinary(part)]


def decode(ids: list[int], rank_path: str, pattern: str) -> bytes:
    """The raw bytes of ids."""
    return encoding(rank_path, pattern).decode_bytes(ids)


def with_ids(docs: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add the column ids (array of int), in place of one of that name."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield texts.map(lambda t: np.array(encode(t, rank_path, pattern), np.int32))
        finally:
            common.release()

    return docs.withColumn("ids", ids(F.col(text)))


def with_decoded(docs: DataFrame, rank_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add the column decoded (string) from ids, in place of one of that name; bytes that are no UTF-8 become U+FFFD."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda x: decode([] if x is None else [int(i) for i in x], rank_path, pattern).decode(errors="replace"))

    return docs.withColumn("decoded", texts(F.col(ids)))


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens and the digests of its ids and of the bytes they decode to."""

    @F.pandas_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for texts in batches:
                rows = []
                for text in texts:
                    ids = encode(text, rank_path, pattern)
                    raw = decode(ids, rank_path, pattern)
                    rows.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            common.release()

    return docs.select("doc_id", digests("text").alias("_d")).select("doc_id", "_d.*")
