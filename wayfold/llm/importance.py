"""Importance resampling towards a target, over hashed n-grams whose CRCs come from prefix CRCs.

A text is reduced to its words with one blank between them and scanned once; what is kept is the CRC-32 of every
prefix that ends with a word, and the bytes each word adds.  No n-gram is hashed: with ``crc(AB) = shift(crc(A), |B|) ^
crc(B)``, where ``shift`` is the linear map of appending ``|B|`` zero bytes (a multiplication in GF(2)[x]), the CRC of
the n-gram ``B`` is the prefix CRC at its end, with the shifted prefix CRC before it cancelled.  Any n costs the same.

The prefix CRCs are a stage table, so that counting and weighing read four bytes a word and no text.  Bucket counts
are summed in each task first (at most ``BUCKETS`` rows a task), and the table of gains has ``BUCKETS`` entries, which
bounds what reaches the driver and what is sent to tasks.  Ranks are counted from a range-partitioned sort.

Defined results: null and wordless texts have no features and weight 0; a null doc_id draws its noise as ``null`` and
comes before other ids at equal scores; repeated rows each have a rank of their own; empty input, empty output.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.session import materialize

MAX_N = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
#: Per cent of the documents with enough words that are drawn.
SHARE = 10
#: Normalised bytes that are held as words at once, and texts whose n-grams are.
BLOCK, TEXTS = 1 << 22, 512

#: A-Z to a-z, then every byte of ASCII that is no letter or digit to a blank; bytes of longer characters stay.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
_POLYNOMIAL = 0xEDB88320


@functools.cache
def _shifts() -> np.ndarray:
    """``[place, digit, byte of the CRC, value]``: the map of appending ``digit * 16 ** place`` zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> 1) ^ np.where(step & 1, np.uint32(_POLYNOMIAL), np.uint32(0)).astype(np.uint32)
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    one = step[basis & 255] ^ (basis >> 8)  # images of the 32 unit vectors under one zero byte

    def after(first: np.ndarray, then: np.ndarray) -> np.ndarray:
        bits = (first[:, None] >> np.arange(32, dtype=np.uint32)) & 1
        return np.bitwise_xor.reduce(np.where(bits == 1, then, 0).astype(np.uint32), axis=1)

    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    out = np.zeros((10, 16, 4, 256), np.uint32)
    for place in range(len(out)):
        power = basis
        for digit in range(16):
            for byte in range(4):
                out[place, digit, byte] = np.bitwise_xor.reduce(np.where(bits == 1, power[8 * byte : 8 * byte + 8], 0).astype(np.uint32), axis=1)
            power = after(power, one)
        one = power
    return out


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRC part of prefixes after ``n`` further bytes."""
    n, place = n.astype(np.int64), 0
    while n.any():
        t, digit = _shifts()[place], n & 15
        crc = t[digit, 0, crc & 255] ^ t[digit, 1, (crc >> 8) & 255] ^ t[digit, 2, (crc >> 16) & 255] ^ t[digit, 3, crc >> 24]
        n, place = n >> 4, place + 1
    return crc


def prefix_crcs(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """CRC of each prefix that ends with a word (uint32), and the bytes each word adds with the blank before it."""
    norm = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    crc, lo, crcs, added = 0, 0, [], []
    while lo < len(norm):
        hi = norm.find(b" ", lo + BLOCK)
        hi = len(norm) if hi < 0 else hi
        parts = b" ".join(norm[lo:hi].split()).replace(b" ", b"\0 ").split(b"\0")
        lo = hi
        if not parts[0]:
            continue
        if added:
            parts[0] = b" " + parts[0]
        run = np.fromiter(itertools.accumulate(parts, lambda c, part: zlib.crc32(part, c), initial=crc), np.uint32, len(parts) + 1)[1:]
        crc = int(run[-1])
        crcs.append(run)
        added.append(np.fromiter(map(len, parts), np.int32, len(parts)))
    return np.concatenate(crcs or [np.zeros(0, np.uint32)]), np.concatenate(added or [np.zeros(0, np.int32)])


def ngrams(crcs: np.ndarray, added: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, CRC) of each run of ``n`` words; text ``i`` has the words from ``starts[i]`` to ``starts[i + 1]``."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.arange(len(crcs))
    first = at == starts[text]
    before = np.zeros(len(crcs), np.uint32)
    before[~first] = shift(crcs[at[~first] - 1], np.ones((~first).sum(), np.int64)) ^ np.uint32(zlib.crc32(b" "))
    ends = np.cumsum(added, dtype=np.int64)
    at = at[at + n <= starts[text + 1]]
    length = ends[at + n - 1] - ends[at] + added[at] - ~first[at]
    return text[at], crcs[at + n - 1] ^ shift(before[at], length)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, TEXTS):
            yield batch.slice(lo, TEXTS)


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix CRCs, added bytes and where each text starts, without copying a value."""
    crcs, added = batch.column("crcs"), batch.column("added")
    starts = crcs.offsets.to_numpy().astype(np.int64)
    values = crcs.values.to_numpy()[starts[0] : starts[-1]].view(np.uint32)
    first = int(added.offsets[0].as_py())
    return values, added.values.to_numpy()[first : first + len(values)], starts - starts[0]


def prefixes(rows: DataFrame) -> DataFrame:
    """``doc_id, crcs, added`` of ``doc_id, text``: what one scan of each text leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found = [prefix_crcs(t.as_py()) for t in batch.column("text")]
            starts = np.cumsum([0, *(len(c) for c, _ in found)], dtype=np.int32)
            crcs, added = (np.concatenate([np.zeros(0, np.int32), *x]) for x in ([c.view(np.int32) for c, _ in found], [a for _, a in found]))
            lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(x)) for x in (crcs, added)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "crcs", "added"])

    many = T.ArrayType(T.IntegerType())
    schema = T.StructType([rows.schema["doc_id"], T.StructField("crcs", many), T.StructField("added", many)])
    return rows.select("doc_id", "text").mapInArrow(run, schema)


def bucket_counts(table: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in _sliced(batches):
            cells = _cells(batch)
            for n in range(1, max_n + 1):
                total += np.bincount(ngrams(*cells, n)[1] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in table.select("crcs", "added").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to raw share of each bucket, one added to every count."""
    s_all, t_all, size = int(raw.sum()), int(target.sum()), len(raw)
    ratio = [(float(t + 1) * float(s_all + size)) / (float(s + 1) * float(t_all + size)) for s, t in zip(raw.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighed(table: DataFrame, gain: np.ndarray, max_n: int = MAX_N) -> DataFrame:
    """``doc_id, n_words, n_features, weight``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            cells = _cells(batch)
            texts = batch.num_rows
            many, total = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
            for n in range(1, max_n + 1):
                text, crc = ngrams(*cells, n)
                many += (now := np.bincount(text, minlength=texts))
                upto = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(len(gain))])])
                total += np.diff(upto[np.concatenate([[0], np.cumsum(now)])])
            weight = np.where(many > 0, total // np.maximum(many, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(cells[2])), pa.array(many), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    schema = T.StructType([table.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    return table.mapInArrow(run, schema)


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank`` from 1 by falling score, then rising doc_id; a task orders one range only."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("weight"), F.asc("n_features")]
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part, within = F.shiftrightunsigned("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row a range
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + within + 1).drop("place", "part", "start")


def resample(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null where it is not drawn.

    ``target`` has the column ``text``.
    """
    table = materialize(prefixes(docs))
    wanted = prefixes(target.select(F.lit(0).alias("doc_id"), "text"))
    gain = gains(bucket_counts(table, max_n, buckets), bucket_counts(wanted, max_n, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = materialize(weighed(table, gain, max_n).withColumn("score", F.col("weight") + noise))
    enough = rows.filter(F.col("n_words") >= min_words)
    most = share * enough.count() // 100
    drawn = _ranked(enough).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    others = rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB twin for n = 1: the CRC of each different word, byte by byte.
RESAMPLE_SQL = rf"""
WITH steps AS (SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
texts AS (SELECT 'raw' AS side, doc_id, row_number() OVER () AS line, text FROM documents UNION ALL SELECT 'target', 0, row_number() OVER (), text FROM benchmark),
words AS (SELECT side, doc_id, line, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
coded AS (SELECT w, list_transform(range(0, CAST(length(hex(encode(w))) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT)) AS bytes FROM (SELECT DISTINCT w FROM words)),
crcs AS (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % {BUCKETS} AS bucket FROM coded, steps),
counts AS (SELECT bucket, count(*) FILTER (WHERE side = 'raw') AS s, count(*) FILTER (WHERE side = 'target') AS t FROM words JOIN crcs USING (w) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + {BUCKETS})) / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + {BUCKETS})))) AS BIGINT) AS g FROM counts),
found AS (SELECT line, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM words JOIN crcs USING (w) JOIN gain USING (bucket) WHERE side = 'raw' GROUP BY line),
scored AS (SELECT x.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(x.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
 FROM texts x LEFT JOIN found USING (line) WHERE x.side = 'raw'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS p, count(*) OVER (PARTITION BY n_features >= {MIN_WORDS}) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_WORDS} AND p <= {SHARE} * n // 100 THEN p END AS rank FROM placed
"""
