"""Lookups and set operations between stores: processed sessions, clusters, adapters, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.filters import MIN_TEXT_CHARS, text_min_length


def not_yet_processed(candidates: DataFrame, processed: DataFrame, id_: str = "session_id") -> DataFrame:
    return candidates.join(processed.select(id_), id_, "left_anti")


def materialize_if_absent(inputs: DataFrame, done: DataFrame, stage, id_: str = "session_id") -> DataFrame:
    """Stage output for the ids the sink does not hold yet; append the result to the sink."""
    return stage(not_yet_processed(inputs, done, id_))


def todo_policies(descriptions: DataFrame, policies: DataFrame, profiles: DataFrame, at_least: int = MIN_TEXT_CHARS) -> DataFrame:
    """Adds the profile and ``status`` to each description: skipped (policy exists, or too short) or generate."""
    made = policies.select("session_id").distinct().withColumn("_made", F.lit(True))
    return (
        descriptions.join(made, "session_id", "left")
        .join(profiles, "session_id", "left")
        .withColumn(
            "status",
            F.when(F.col("_made"), F.lit("skipped_exists"))
            .when(~text_min_length(F.col("text"), at_least), F.lit("skipped_short"))
            .otherwise(F.lit("generate")),
        )
        .drop("_made")
    )


def cluster_catalog(clusters: DataFrame, adapters: DataFrame) -> DataFrame:
    """All known clusters, with metadata or adapter or both, by id."""
    have = adapters.select("cluster_id").distinct().withColumn("has_adapter", F.lit(True))
    fallback = F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))
    return (
        clusters.join(have, "cluster_id", "full_outer")
        .withColumns({"has_adapter": F.coalesce("has_adapter", F.lit(False)), "label": F.coalesce("label", fallback)})
        .orderBy("cluster_id")
    )


def runnable_clusters(clusters: DataFrame, models: DataFrame) -> DataFrame:
    """Clusters with a successfully tuned model."""
    good = models.filter((F.col("status") == "success") & F.col("model_id").isNotNull())
    return clusters.join(good.select("cluster_id"), "cluster_id", "left_semi")


def processing_status(ids: DataFrame, in_flight: DataFrame, processed: DataFrame) -> DataFrame:
    """State of each asked session: its running state, else ``completed``, else ``unknown``."""
    running = in_flight.select("session_id", F.col("status").alias("_running"))
    done = processed.select("session_id", "cluster_id").withColumn("_done", F.lit("completed"))
    return (
        ids.join(running, "session_id", "left")
        .join(done, "session_id", "left")
        .withColumn("status", F.coalesce("_running", "_done", F.lit("unknown")))
        .drop("_running", "_done")
    )


def prefer_real(real: DataFrame, old: DataFrame) -> DataFrame:
    """The real set when it has any row, else the old one; decided by one subquery."""
    return real.unionByName(old.filter(~real.exists()))


def valid_clusters(available: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Requested ids that exist; no request means all."""
    every = available.select("cluster_id").distinct()
    if requested is None:
        return every
    asked = requested.select("cluster_id")
    return every.join(asked, "cluster_id", "left_semi").unionByName(every.filter(~asked.exists()))
