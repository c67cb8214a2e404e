"""K-Means with several starts, and its capacity-balanced variant."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.vectors import nearest_listed
from wayfold.session import materialize

STARTS = 10
SEED = 42
BINS = 1_024
LISTED = 64
"""Preferences that a point row holds at a time; a point that all of them reject gets its next ones."""


def fit_kmeans(points: DataFrame, k: int, vector: str = "embedding", starts: int = STARTS, seed: int = SEED) -> KMeansModel:
    """Best of ``starts`` fits by training cost; ``k`` shrinks to the number of points."""
    features = points.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")).persist()
    try:
        k = max(1, min(k, features.limit(k).count()))
        if k == 1:
            k, starts = 1, 1
        fits = (KMeans(k=k, seed=seed + i, featuresCol="features").fit(features) for i in range(starts))
        return min(fits, key=lambda model: model.summary.trainingCost)
    finally:
        features.unpersist()


def centroid_table(model: KMeansModel, like: DataFrame) -> DataFrame:
    """Fitted centres as ``(cluster_id, centroid)``."""
    rows = [(i, [float(x) for x in centre]) for i, centre in enumerate(model.clusterCenters())]
    return like.sparkSession.createDataFrame(rows, "cluster_id BIGINT, centroid ARRAY<DOUBLE>")


def assign(model: KMeansModel, points: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``cluster_id`` of the fitted model."""
    prepared = points.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    return model.transform(prepared).withColumn("cluster_id", F.col("prediction").cast("long")).drop("features", "prediction")


def _bounded_table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A table of one row per cluster, small by the limit on the number of centroids."""
    names = [column.split()[0] for column in schema.split(", ")]
    return F.broadcast(df.sparkSession.createDataFrame(pd.DataFrame(rows, columns=names), schema))


def select_rank(df: DataFrame, group: str, value: str, ranks: dict[int, int], descending: bool) -> dict[int, tuple]:
    """Exact order statistic per group: ``{group: (value, rank among the rows equal to it)}``.

    Every pass is one map-side combined histogram over the interval that still holds the
    wanted row, so neither a large group nor a pile of equal values is ever sorted.
    """
    sign = -1 if descending else 1
    scored = df.select(F.col(group).cast("long").alias("g"), (F.col(value) * sign).alias("v"))
    kind = dict(scored.dtypes)["v"]
    asked = _bounded_table(df, [(g,) for g in ranks], "g BIGINT")
    limits = scored.join(asked, "g").groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    spans, wanted, done = {r["g"]: (r["lo"], r["hi"]) for r in limits}, dict(ranks), {}
    while wanted:
        for g in [g for g in wanted if spans[g][0] == spans[g][1]]:
            done[g] = (spans[g][0] * sign, wanted.pop(g))
        if not wanted:
            break
        table = _bounded_table(df, [(g, *spans[g]) for g in wanted], f"g BIGINT, lo {kind}, hi {kind}")
        low, high = F.col("lo").cast("double"), F.col("hi").cast("double")
        place = F.try_divide(F.col("v").cast("double") - low, high - low)
        # Both ends have a bin of their own, so every pass narrows the interval.
        inner = F.floor(F.coalesce(place, F.lit(0.0)) * F.lit(float(BINS))).cast("int")
        bin_ = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), BINS - 1).otherwise(
            F.greatest(F.lit(1), F.least(F.lit(BINS - 2), inner)))
        histogram = (
            scored.join(table, "g").filter(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("g", bin_.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
        )
        for g in wanted:
            left = wanted[g]
            for row in sorted((r for r in histogram if r["g"] == g), key=lambda r: r["bin"]):
                if left <= row["n"]:
                    wanted[g], spans[g] = left, (row["least"], row["most"])
                    break
                left -= row["n"]
    return done


def balanced_assign(points: DataFrame, centroids: DataFrame, id_: str, vector: str = "embedding") -> DataFrame:
    """Capacity-balanced assignment: ``(id, cluster_id, distance)``.

    Points farthest from their nearest centroid choose first, each taking the nearest cluster
    with room.  With one common priority this is the stable matching, so it is described by one
    cut-off per cluster: the weakest priority still admitted.  Each round lets every point take
    the nearest cluster that admits it and raises the cut-off of overfull clusters; the loop
    state is k numbers, and every round is an aggregation over the points.

    A row holds its ``LISTED`` nearest clusters.  Cut-offs only rise, so a cluster that rejects a
    point does so for good, and a point rejected by all listed ones goes on with the next ones.
    """
    centroids = materialize(centroids.select(F.col("cluster_id").cast("long").alias("cluster_id"), "centroid"))
    ids = np.sort(np.array([r["cluster_id"] for r in centroids.select("cluster_id").collect()], dtype=np.int64))
    k = len(ids)
    kind = dict(points.dtypes)[id_]
    tie = F.col(id_).cast("long") if kind in ("int", "bigint", "smallint", "tinyint") else F.xxhash64(id_)
    place = F.lit(ids)  # one literal, however many clusters

    def listed(rows: DataFrame, beyond=None) -> DataFrame:
        near = nearest_listed(rows, centroids, LISTED, "_near", vector, beyond)
        numbered = F.transform("_near", lambda p: F.struct(p["d"].alias("d"), (F.array_position(place, p["id"]) - 1).cast("int").alias("i"), p["id"].alias("id")))
        return near.withColumn("prefs", numbered).drop("_near")

    start = listed(points.select(id_, tie.alias("tie"), F.col(vector)))
    more = [vector] if k > LISTED else []
    table = materialize(start.select(id_, "tie", F.get("prefs", F.lit(0))["d"].alias("own_distance"), "prefs", *more))
    n = table.count()
    capacity = n // k + (1 if n % k else 0) if k else 0
    # Distances are never negative, so a cut-off of -1 admits every point.
    cutoffs: list[tuple] = [(-1.0, 0)] * k
    own, tie_col = F.col("own_distance"), F.col("tie")
    while True:
        edges = F.lit(np.array([float(d) for d, _ in cutoffs]))
        last = F.lit(np.array([x for _, x in cutoffs], dtype=np.int64))

        def admits(p, edges=edges, last=last):
            edge = F.element_at(edges, p["i"] + 1)
            return (own > edge) | ((own == edge) & (tie_col <= F.element_at(last, p["i"] + 1)))

        chosen = table.withColumn("_c", F.try_element_at(F.filter("prefs", lambda p: admits(p)), F.lit(1)))
        slot = chosen.select("own_distance", "tie", F.col("_c.i").alias("slot"))
        counts = {r["slot"]: r["n"] for r in slot.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()}
        if None in counts and k > LISTED:
            left = chosen.filter("_c IS NULL AND own_distance IS NOT NULL").drop("_c")
            next_ones = listed(left.withColumn("_from", F.element_at("prefs", -1)).drop("prefs"), F.col("_from")).drop("_from")
            table = materialize(chosen.filter("_c IS NOT NULL OR own_distance IS NULL").drop("_c").unionByName(next_ones))
            continue
        over = {g: capacity for g, rows in counts.items() if g is not None and rows > capacity}
        if not over:
            break
        edge = select_rank(slot, "slot", "own_distance", over, descending=True)
        marks = _bounded_table(points, [(g, float(d)) for g, (d, _) in edge.items()], "slot BIGINT, own_distance DOUBLE")
        at_edge = slot.withColumn("slot", F.col("slot").cast("long")).join(marks, ["slot", "own_distance"])
        ties = select_rank(at_edge, "slot", "tie", {g: rank for g, (_, rank) in edge.items()}, descending=False)
        for g, (distance, _) in edge.items():
            cutoffs[g] = (distance, ties[g][0])
    return chosen.select(id_, F.col("_c.id").alias("cluster_id"), F.col("_c.d").alias("distance"))


def balanced_kmeans(points: DataFrame, k: int, id_: str, vector: str = "embedding", seed: int = SEED, starts: int = STARTS) -> tuple[DataFrame, KMeansModel]:
    """Fit, then balance: cluster sizes differ from n/k only by the remainder."""
    model = fit_kmeans(points, k, vector, starts, seed)
    return balanced_assign(points, centroid_table(model, points), id_, vector), model
