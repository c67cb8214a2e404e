"""Packing by first-fit decreasing with a tournament tree, in randomised groups of documents.

Documents become token ids (an end id closes each); whole pieces of the sequence length stand alone, what is
left over is packed by first-fit decreasing inside its group: a tournament tree over the open bins keeps the
largest free room of every subtree, so the first bin that fits is found in logarithmic time.

Defined results: null and empty texts are one end id; equal rows are packed like different ones; a text of any
length is cut at multiples of the length; every id lies in one piece; empty input gives no piece.
Groups are dealt by a hash of a stored row number, never by document, so copies spread; their number follows the
row count and a group stays at about ``GROUP_ROWS`` rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import record_batches
from wayfold.session import materialize

LENGTH = 2048
END_ID = 1
GROUP_ROWS = 4096


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """Byte-level BPE of the ranks at ``path``; same ids as ``byte_bpe_50k.json`` gives (tested), four times as fast.

    As there, the tokenizer's added tokens are one id each where a text holds them.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: encoding.encode(text, allowed_special="all")


class Tournament:
    """A complete binary tree whose inner nodes hold the larger free room of their two children."""

    def __init__(self, n: int, room: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.tree = [room] * (2 * self.size)

    def place(self, need: int) -> int:
        """The first bin with room for ``need``; its room shrinks."""
        tree, i = self.tree, 1
        while i < self.size:
            i *= 2
            if tree[i] < need:
                i += 1
        found, left = i - self.size, tree[i] - need
        tree[i] = left
        while i > 1:
            i //= 2
            best = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best
        return found


def first_fit_decreasing(lengths: list[int], room: int = LENGTH) -> list[int]:
    """The bin of each length; ties keep their order."""
    bins, tree = [0] * len(lengths), Tournament(len(lengths), room)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bins[i] = tree.place(lengths[i])
    return bins


_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens")])


def _pieces(batches: Iterator[pa.RecordBatch], path: str, length: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc, row, text in zip(batch.column("doc_id"), batch.column("row"), batch.column("text")):
                doc, row = doc.as_py(), row.as_py()
                ids = np.array([*encode(text.as_py()), END_ID], dtype="<u4")
                yield from ((doc, row, s, min(length, len(ids) - s), zlib.crc32(ids[s : s + length].tobytes()), len(ids)) for s in range(0, len(ids), length))

    return record_batches(rows(), _PIECES)


def _pack_group(group: pd.DataFrame, room: int) -> pd.DataFrame:
    group = group.sort_values(["row", "start"], kind="stable").reset_index(drop=True)
    lengths = group["length"].tolist()
    bins = first_fit_decreasing(lengths, room)
    filled, offsets = {}, []
    for b, n in zip(bins, lengths):
        offsets.append(filled.get(b, 0))
        filled[b] = offsets[-1] + n
    group["sequence_id"] = group["part"].astype("int64") * 2**32 + np.array(bins, dtype="int64")
    group["offset"] = np.array(offsets, dtype="int64")
    return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]


def pack(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS, path: str | None = None) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    path = path or tokenizer_path()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    schema = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = materialize(rows.mapInArrow(lambda it: _pieces(it, path, length), schema))
    full = pieces.filter(F.col("length") == length).withColumn("at", F.monotonically_increasing_id())
    alone = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (-1 - F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < length)
    groups = max(1, -(-rest.count() // group_rows))
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return alone.unionByName(dealt.groupBy("part").applyInPandas(lambda g: _pack_group(g, length), out))
