"""Sets of word shingles as hashes, and pairs of texts counted by them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.session import materialize

STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over each other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Different hashes (uint64, ascending) of the runs of ``width`` lowered words; of all words, if they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower is A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_hash, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        out = mixed(out * STEP + hashes[i : i + n])
    return np.unique(out)


def set_digest(hashes: np.ndarray) -> str:
    """128 bits of a set; equal sets are one node."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest()


def text_key(text: Column, doc_id: Column) -> Column:
    """What a row is found again by: its id and text, so that copies of one text are not one key."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))))


def shingled(asked: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``id, s``: the full sets of the nodes ``asked`` (``id``, no repeats).

    ``nodes`` has ``id`` and the ``text_key`` of one of its rows in ``docs``.  Only texts that are asked for are moved.
    """
    wanted = nodes.join(asked, "id").select("id", "text_key")
    texts = docs.select(text_key(F.col("text"), F.col("doc_id")).alias("text_key"), "text").join(wanted, "text_key").select("id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                found = [shingle_set(t.as_py(), width).view(np.int64) for t in piece.column("text")]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32)), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([piece.column("id"), lists], names=["id", "s"])

    return materialize(texts.mapInArrow(sets, "id long, s array<long>").dropDuplicates(["id"]))


def alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose full sets share at least ``percent`` per cent of their union."""
    pairs = materialize(pairs)
    if pairs.isEmpty():
        return pairs
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array([shared(s.values.to_numpy(), t.values.to_numpy(), percent) for s, t in zip(batch.column("s"), batch.column("t"))], pa.bool_()))

    found = shingled(asked, nodes, docs, width)
    both = pairs.join(found.select(F.col("id").alias("a"), "s"), "a").join(found.select(F.col("id").alias("b"), F.col("s").alias("t")), "b")
    return materialize(both.select("a", "b", "s", "t").mapInArrow(count, "a long, b long"))


def shared(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least ``percent`` per cent of their union."""
    if min(len(left), len(right)) * 100 < percent * max(len(left), len(right)):
        return False
    both = np.sort(np.concatenate([left, right]))
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)
