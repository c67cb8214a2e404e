"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wayfold.plans import QUERIES  # noqa: E402
from wayfold.session import local_session  # noqa: E402

HEADLINE = [
    "session_overview", "actions_table", "collapse_scrolls", "resolve_node", "high_level_actions", "normalize_flat_event",
    "hesitation_ms", "recent_window", "training_examples", "sequence_split", "session_summary", "timing_deltas", "positional_match",
    "error_streak", "impressions", "run_all_scorers", "friction_items", "behaviour_features", "behaviour_keywords", "cluster_profile",
    "distance_matrix", "nearest_centroid", "balanced_assign", "page_observation", "markdown_report", "download_candidates",
    "not_yet_processed", "new_since_retrain", "stream_dedupe", "stream_stuck",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["overall_rollup"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
