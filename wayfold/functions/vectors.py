"""Distances to a set of centroids of any size.

The centres travel with the tasks in blocks of bounded size, one block after the other, and a point
carries what it has found so far: its nearest centre, or its nearest few.  A point row never holds a
block, and equal points need no grouping.  After each block but the last the points are a stage table,
so a task holds one block at a time and a lost executor costs one block's pass.

Defined results: a null vector has null distances; ties go to the lowest id; no centres, null results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.session import materialize

BLOCK_VALUES = 1 << 22
"""Numbers in one block of centres (32 MB)."""


def centroid_means(points: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Element-wise mean per label: ``(cluster_id, centroid)``; means are combined map-side."""
    return points.groupBy(F.col(label).cast("long").alias("cluster_id")).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias("centroid")
    )


def centre_blocks(centroids: DataFrame, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of ``cluster_id, centroid`` rows, ids ascending in a block; the driver holds one block, and a partition of rows on their way."""
    ids, rows = [], []
    for cluster_id, centroid in centroids.select("cluster_id", "centroid").toLocalIterator():
        ids.append(cluster_id)
        rows.append(centroid)
        if len(rows) * max(1, len(centroid)) >= (size or BLOCK_VALUES):
            yield _sorted(ids, rows)
            ids, rows = [], []
    if rows:
        yield _sorted(ids, rows)


def _sorted(ids: list[int], rows: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
    return np.array(ids, dtype=np.int64)[order], np.array(rows, dtype=np.float64)[order]


def _distances(batch: pd.Series, matrix: np.ndarray) -> np.ndarray:
    points = np.array(batch.tolist(), dtype=np.float64).reshape(len(batch), -1)
    out = np.empty((len(points), len(matrix)))
    for i, centre in enumerate(matrix):  # one pass per centroid keeps the working set small
        delta = points - centre
        out[:, i] = np.sqrt(np.einsum("ij,ij->i", delta, delta))
    return out


def _nearest_of(ids: np.ndarray, matrix: np.ndarray, vector: Column) -> Column:
    """The nearest (d, id) of a block; ids ascend, so the first of equal distances has the lowest."""

    def measure(vectors: pd.Series) -> pd.DataFrame:
        known = vectors.notna().to_numpy()
        out = pd.DataFrame({"d": np.nan, "id": pd.array([pd.NA] * len(vectors), dtype="Int64")})
        if known.any():
            found = _distances(vectors[known], matrix)
            at = found.argmin(1)
            out.loc[known, "d"], out.loc[known, "id"] = found[np.arange(len(at)), at], ids[at]
        return out

    found = F.pandas_udf(measure, "struct<d: double, id: bigint>")(vector)
    return F.when(found["id"].isNotNull(), found)


def _listed(ids: np.ndarray, matrix: np.ndarray, most: int | None) -> Callable:
    """A column function of a vector and a (distance, id) pair: the distances to a block beyond that pair, nearest
    first, as ``struct<d: array<double>, id: array<bigint>>``; all of them, or the first ``most``.
    """

    def measure(vectors: pd.Series, from_d: pd.Series, from_id: pd.Series) -> pd.DataFrame:
        out = [(None, None)] * len(vectors)
        known = np.flatnonzero(vectors.notna().to_numpy())
        if len(known):
            found = _distances(vectors.iloc[known], matrix)
            for at, row, order in zip(known, found, np.argsort(found, axis=1, kind="stable")):  # ids ascend
                d, i = from_d.iloc[at], from_id.iloc[at]
                if not np.isnan(d):
                    order = order[(row[order] > d) | ((row[order] == d) & (ids[order] > i))]
                out[at] = (row[order[:most]], ids[order[:most]])
        return pd.DataFrame(out, columns=["d", "id"])

    return F.pandas_udf(measure, "struct<d: array<double>, id: array<bigint>>")


def _pairs(ids: np.ndarray, matrix: np.ndarray, vector: Column, most: int | None = None, beyond: Column | None = None) -> Column:
    """Array of (d, id) of a block, nearest first; only those after ``beyond``, a (d, id) struct."""
    none = F.lit(None)
    d, i = (none.cast("double"), F.lit(0).cast("long")) if beyond is None else (beyond["d"], F.coalesce(beyond["id"], F.lit(0).cast("long")))
    found = _listed(ids, matrix, most)(vector, d, i)
    return F.arrays_zip(found["d"].alias("d"), found["id"].alias("id"))


def nearest_listed(points: DataFrame, centroids: DataFrame, most: int, name: str, vector: str = "embedding", beyond: Column | None = None) -> DataFrame:
    """Adds ``name``: the ``most`` nearest (d, id), nearest first; with ``beyond`` those after that pair."""
    out = points.withColumn(name, F.lit(None).cast("array<struct<d: double, id: bigint>>"))
    for turn, (ids, matrix) in enumerate(centre_blocks(centroids)):
        if turn:
            out = materialize(out)
        found = _pairs(ids, matrix, F.col(vector), most, beyond)
        both = F.slice(F.array_sort(F.concat(F.col(name), found)), 1, most)
        out = out.withColumn(name, both if turn else found)
    return out


def distance_matrix(points: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Every point with every centroid: ``(…, cluster_id, distance)`` without the vector."""
    keep = [c for c in points.columns if c != vector]
    out = points.limit(0).select(*keep, F.lit(0).cast("long").alias("cluster_id"), F.lit(0.0).alias("distance"))
    for turn, (ids, matrix) in enumerate(centre_blocks(centroids)):
        pairs = points.select(*keep, F.explode(_pairs(ids, matrix, F.col(vector))).alias("_p"))
        some = pairs.select(*keep, F.col("_p.id").alias("cluster_id"), F.col("_p.d").alias("distance"))
        out = out.unionByName(some) if turn else some
    return out


def nearest_centroid(points: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``cluster_id`` and ``distance`` of the closest centroid (lowest id on a tie)."""
    out = points.withColumn("_near", F.lit(None).cast("struct<d: double, id: bigint>"))
    for turn, (ids, matrix) in enumerate(centre_blocks(centroids)):
        if turn:
            out = materialize(out)
        found = _nearest_of(ids, matrix, F.col(vector))
        out = out.withColumn("_near", F.least("_near", found) if turn else found)
    return out.withColumns({"cluster_id": F.col("_near.id"), "distance": F.col("_near.d")}).drop("_near")
