"""What the operators of this folder share: words, null-safe text, unused column names, seeded hashes, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of code points that are none of these six.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
#: Rows that are Python objects at once: ten thousand texts, or what is found in them, fill a worker, which keeps that memory.
TOGETHER = 1024


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` parts exactly at the six ASCII spaces."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def record_batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows in Arrow batches of at most ``TOGETHER``; no row is asked for before its batch is."""
    rows = iter(rows)
    while some := list(islice(rows, TOGETHER)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that no column of ``taken`` has, whatever the case."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def seeded_hash(seed: int, *keys: Column) -> Column:
    """60 bits of MD5 over the seed and the keys (null counts as a key of its own); DuckDB computes the same."""
    parts = [F.coalesce(k.cast("string"), F.lit("null")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def seeded_hash_sql(seed: int, *keys: str) -> str:
    """DuckDB twin of ``seeded_hash``."""
    parts = ", ".join(f"coalesce(CAST({k} AS VARCHAR), 'null')" for k in keys)
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {parts})), 1, 15) AS BIGINT)"


def null_safe(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition in which nulls of both sides are equal."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out
