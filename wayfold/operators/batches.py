"""Applying a user function (a model call, say) to every row, with retries on rate limits."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.catalogue import not_yet_processed

RETRIES = 5
RATE_LIMIT_MARK = "429"


def _call(fn: Callable, value, retries: int, sleep: Callable[[float], None]):
    for attempt in range(retries):
        try:
            return fn(value), None, attempt + 1
        except Exception as error:  # noqa: BLE001 - the user's function may raise anything
            if RATE_LIMIT_MARK not in str(error) or attempt == retries - 1:
                return None, str(error), attempt + 1
            sleep(2**attempt + random.uniform(0, 1))
    return None, "no attempt made", 0


def score_batches(
    df: DataFrame,
    fn: Callable[[str], str],
    column: str,
    id_: str = "session_id",
    done: DataFrame | None = None,
    retries: int = RETRIES,
    concurrency: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """``(id, result, error, attempts)``; a row that fails has a null result, and rows in ``done`` are skipped.

    Only a rate-limit error is retried, after ``2^i`` seconds plus jitter.  ``concurrency`` is the
    number of partitions, that is of calls in flight.
    """
    rows = df if done is None else not_yet_processed(df, done, id_)
    rows = rows.select(id_, column)
    if concurrency:
        rows = rows.repartition(concurrency)
    kind = dict(df.dtypes)[id_]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [_call(fn, v, retries, sleep) for v in batch[column]]
            yield pd.DataFrame({
                id_: batch[id_],
                "result": pd.Series([o[0] for o in out], dtype=object, index=batch.index),
                "error": pd.Series([o[1] for o in out], dtype=object, index=batch.index),
                "attempts": pd.Series([o[2] for o in out], dtype="int64", index=batch.index)})

    return rows.mapInPandas(run, f"{id_} {kind}, result STRING, error STRING, attempts BIGINT")
