"""Row and session filters of the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Action kinds that no user performs.
NON_USER_ACTIONS = ["API_CALL", "PAGE_LOAD", "FULL_SNAPSHOT", "PAGE_META"]

MIN_ACTIONS_BATCH, MIN_ACTIONS_SYNTHETIC, MIN_ACTIONS_ONLINE = 5, 3, 3
MIN_DURATION_S = 10
MIN_TEXT_CHARS = 100


def is_user_action(action: Column) -> Column:
    return ~action.isin(NON_USER_ACTIONS)


def min_actions(actions: DataFrame, at_least: int = MIN_ACTIONS_BATCH) -> DataFrame:
    """``(session_id, n_actions)`` of the sessions long enough to describe; semi-join to keep their rows."""
    return actions.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_actions")).filter(F.col("n_actions") >= at_least)


def real_actions(actions: DataFrame, at_least: int = 3) -> DataFrame:
    """Sessions with enough user actions: ``(session_id, n_actions, n_real_actions)``."""
    return (
        actions.groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("n_actions"), F.count_if(is_user_action(F.col("action"))).alias("n_real_actions"))
        .filter(F.col("n_real_actions") >= at_least)
    )


def download_candidates(listing: DataFrame, stored: DataFrame, min_duration: float = MIN_DURATION_S) -> DataFrame:
    """Adds ``bucket``: already stored, too short, or to download (in this order)."""
    known = stored.select("recording_id").distinct().withColumn("_stored", F.lit(True))
    return (
        listing.join(known, "recording_id", "left")
        .withColumn(
            "bucket",
            F.when(F.col("_stored"), F.lit("skipped_existing"))
            .when(F.coalesce("recording_duration", F.lit(0.0)) < min_duration, F.lit("skipped_short"))
            .otherwise(F.lit("to_download")),
        )
        .drop("_stored")
    )


def text_min_length(text: Column, at_least: int = MIN_TEXT_CHARS) -> Column:
    """Whether the text, trimmed of white space, is long enough to work with."""
    return F.length(F.regexp_replace(text, r"^\s+|\s+\z", "")) >= at_least


def host_of(url: Column) -> Column:
    """Lower-case host name without user or port; empty when there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def network_location(url: Column) -> Column:
    """Host with port, as the same-domain rule compares it."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def host_block(url: Column, blocked: list[str]) -> Column:
    """True when the host contains any blocked name."""
    hit = F.lit(False)
    for name in blocked:
        hit = hit | host_of(url).contains(name)
    return hit


def same_domain_target(url: Column, home: str) -> Column:
    """Where a navigation really goes: relative paths join the home site, foreign sites fall back to home."""
    origin = F.regexp_extract(F.lit(home), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    clean = F.trim(url)
    absolute = F.when(clean.startswith("/"), F.concat(origin, clean)).otherwise(clean)
    place = network_location(absolute)
    return F.when((place != "") & (place != network_location(F.lit(home))), F.lit(home)).otherwise(absolute)


def min_examples(counts: DataFrame, at_least: int = 10) -> DataFrame:
    """Adds ``status`` and ``reason`` to per-cluster example counts."""
    enough = F.col("examples") >= at_least
    reason = F.concat(F.lit("Too few training examples ("), F.col("examples").cast("string"), F.lit(")"))
    return counts.withColumns(
        {"status": F.when(enough, F.lit("ready")).otherwise(F.lit("skipped")), "reason": F.when(~enough, reason)}
    )


def sessions_of_cluster(assignments: DataFrame, cluster_id: int) -> DataFrame:
    return assignments.filter(F.col("cluster_id") == cluster_id)
