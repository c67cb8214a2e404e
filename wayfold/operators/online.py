"""State of the online path, derived by aggregation from append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRAIN_THRESHOLD = 2
RECENT_SESSIONS, RECENT_RETRAINS, LISTING_PAGE = 10, 5, 20


def last_retrains(retrains: DataFrame) -> DataFrame:
    """``(cluster_id, last_retrain)``: newest job that covered the cluster."""
    return (
        retrains.select(F.explode("cluster_ids").alias("cluster_id"), "triggered_at")
        .groupBy("cluster_id").agg(F.max("triggered_at").alias("last_retrain"))
    )


def new_since_retrain(processed: DataFrame, retrains: DataFrame) -> DataFrame:
    """Sessions that arrived after the latest retrain of their cluster (all, if it never had one)."""
    return processed.join(last_retrains(retrains), "cluster_id", "left").filter(
        F.col("last_retrain").isNull() | (F.col("processed_at") > F.col("last_retrain"))
    )


def new_counts(processed: DataFrame, retrains: DataFrame) -> DataFrame:
    """New sessions per cluster; a session recorded twice counts once."""
    return new_since_retrain(processed, retrains).groupBy("cluster_id").agg(F.count_distinct("session_id").alias("new_sessions"))


def retrain_ready(counts: DataFrame, threshold: int = RETRAIN_THRESHOLD) -> DataFrame:
    return counts.filter(F.col("new_sessions") >= threshold)


def pipeline_status(processed: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: sessions processed in total and new ones per cluster as a map (one entry per cluster)."""
    total = processed.agg(F.count_distinct("session_id").alias("n"))
    pair = F.struct(F.col("cluster_id").cast("string"), "new_sessions")
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("cluster_new_counts")).withColumn(
        "total_processed", total.scalar()
    )


def recent_sessions(processed: DataFrame, n: int = RECENT_SESSIONS) -> DataFrame:
    return processed.orderBy(F.desc("processed_at"), "session_id").limit(n)


def page_of_listing(recordings: DataFrame, limit: int = LISTING_PAGE) -> DataFrame:
    """Newest recordings first, one page."""
    return recordings.orderBy(F.desc("start_time"), "recording_id").limit(limit)


def retrain_history(transitions: DataFrame) -> DataFrame:
    """Current state per job from its status events ``(job_id, status, details, updated_at, event_no)``."""
    at = F.struct("updated_at", "event_no")
    return transitions.groupBy("job_id").agg(
        F.min("updated_at").alias("triggered_at"),
        F.max_by("status", at).alias("status"),
        F.max_by("details", F.when(F.coalesce("details", F.lit("")) != "", at)).alias("details"),
        F.max("updated_at").alias("updated_at"),
    )


FINISHED = ["completed", "failed"]


def admit_retrain(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Adds ``status`` to job requests: only one job may run at a time."""
    running = history.filter(~F.col("status").isin(FINISHED)).exists()
    return requests.withColumn("status", F.when(running, F.lit("already_running")).when(F.size("cluster_ids") == 0, F.lit("no_data")).otherwise(F.lit("started")))
