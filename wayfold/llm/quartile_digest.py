"""Document fingerprints by quartile bucket digests, compared with a bounded difference score.

Every run of three bytes is hashed into 128 buckets; a bucket is coded 0 to 3 by the quartile its count falls
in, and the digest is the length (a logarithm), the two quartile ratios and the 128 codes as hex.  The
difference adds code distances (a distance of 3 counts 6) and bounded terms for length and ratios; likeness is
1 minus the difference over ``WORST``.

Defined results: null text is empty; a text of fewer than three bytes has zero counts; equal texts have equal
digests; rows of equal id follow each other by text digest; null ids come first; after the last row the first
follows; a single row follows itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.session import materialize

BUCKETS = 128
#: A code distance of 0, 1, 2, 3 adds this much.
STEP = np.array([0, 1, 2, 6])
LENGTH_MOST, RATIO_MOST = 48, 12
#: Four buckets of five differ by chance at most this much in practice; larger differences count as wholly unlike.
WORST = 160
#: Cut points of the id ranges in which rows are ordered.
RANGES = 400


def fingerprint(data: bytes) -> str:
    """The digest of a text's UTF-8 bytes: 2 hex digits of length, 2 of ratios, 64 of bucket codes."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) if len(b) > 2 else b[:0]
    h ^= h >> np.uint32(15)
    h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(25)
    counts = np.bincount(h, minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[31, 63, 95]]
    codes = (counts > q1).astype(int) + (counts > q2) + (counts > q3)
    length = min(255, int(np.log(len(data) + 1) * 12))
    ratios = (int(q1 * 16 // (q3 + 1)), int(q2 * 16 // (q3 + 1)))
    packed = (codes.reshape(-1, 4) * np.array([64, 16, 4, 1])).sum(1).astype(np.uint8)
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}{packed.tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0."""
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    shifts = np.array([6, 4, 2, 0], np.uint8)
    cx, cy = (((z[2:, None] >> shifts) & 3).astype(int) for z in (x, y))
    far = int(STEP[np.abs(cx - cy)].sum())
    far += min(LENGTH_MOST, abs(int(x[0]) - int(y[0])))
    far += min(RATIO_MOST, abs(int(x[1]) // 16 - int(y[1]) // 16) + abs(int(x[1]) % 16 - int(y[1]) % 16))
    return max(0.0, 1.0 - far / WORST)


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as much of the beginning of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order, range after range; each is put out when its follower is seen."""
    last = None
    for batch in batches:
        out = []
        for part, doc, text, ghost in zip(batch["part"], batch["doc_id"], batch["text"], batch["ghost"]):
            data = text.encode("utf-8", "surrogatepass")
            now = (part, doc, text, fingerprint(data))
            if last is not None and last[0] == part:
                new = edited(last[2], text)
                raw = new.encode("utf-8", "surrogatepass")
                code = fingerprint(raw)
                out.append((None if pd.isna(last[1]) else int(last[1]), len(last[2]), hashlib.sha256(raw).hexdigest(), last[3], code, likeness(last[3], code), likeness(last[3], now[3])))
            last = None if ghost else now
        frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def fingerprint_documents(docs: DataFrame, ranges: int = RANGES) -> DataFrame:
    """One row a document with its digest, that of its edited text and their likeness to it and to the next one's.

    Ids are cut into ranges at approximate percentiles; each range is ordered on its own, and the first row of
    the next range is copied to its end, so texts are shuffled once and no task orders the whole table.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10000)).head()[0] or []
    known = F.lit(sorted(set(cuts))).cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(known, lambda c: c <= F.col("doc_id"))))
    rows = rows.withColumn("part", part.cast("int")).withColumn("order", F.md5("text"))
    first = materialize(rows.groupBy("part").agg(F.min(F.struct("doc_id", "order", "text")).alias("r")))
    heads = first.select("part", "r.*").select(
        F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy())).alias("part"), "doc_id", "text", "order", F.lit(True).alias("ghost")
    )
    both = rows.select("part", "doc_id", "text", "order", F.lit(False).alias("ghost")).unionByName(heads)
    spread = both.repartition("part").sortWithinPartitions("part", "ghost", "doc_id", "order")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return spread.select("part", "doc_id", "text", "ghost").mapInPandas(_pairs, schema)
