"""Scores of agent sessions and the aggregates behind the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.exprs import centis, fixed1, ratio, rounded


def _history(history: DataFrame) -> DataFrame:
    action = F.col("action")
    return history.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("success").alias("ok"),
        F.max("relative_s").alias("duration"),
        F.count_if(action == "click").alias("clicks"),
        F.count_if(action == "scroll").alias("scrolls"),
        F.count_if(action == "type").alias("types"),
        F.count_distinct(action).alias("kinds"),
        F.count_distinct(F.nullif("target", F.lit(""))).alias("targets"),
    )


def _impressions(impressions: DataFrame) -> DataFrame:
    url = F.col("url")
    return impressions.groupBy("session_id").agg(
        F.count_distinct(F.when(~url.isin("", "unknown"), url)).alias("pages"),
        F.count_if(F.col("sentiment").isin("frustration", "confusion")).alias("upset"),
        F.count_if(F.lower("context").contains("stuck")).alias("stuck"),
        F.count_if(F.col("sentiment") == "summary").alias("summaries"),
    )


def session_facts(history: DataFrame, impressions: DataFrame) -> DataFrame:
    """The counts every scorer reads: one aggregate over each input, joined per session."""
    joined = _history(history).join(_impressions(impressions), "session_id", "left")
    return joined.fillna(0, ["pages", "upset", "stuck", "summaries"])


def _share(part: Column, whole: str = "n") -> Column:
    return part.cast("double") / F.greatest(F.col(whole), F.lit(1))


def score_exploration() -> Column:
    pages = F.col("pages")
    return F.struct(
        pages.alias("pages_discovered"),
        F.col("targets").alias("unique_targets_interacted"),
        F.col("n").alias("total_actions"),
        F.col("ok").alias("successful_actions"),
        rounded(_share(F.col("ok")), 3).alias("success_rate"),
        rounded(pages.cast("double") / F.greatest(pages, F.lit(1)), 3).alias("coverage_score"),
    )


def score_consistency(label: Column | None = None) -> Column:
    pace = F.col("n") / F.greatest(F.col("duration"), F.lit(1.0)) * F.lit(60.0)
    variety = _share(F.col("kinds"))
    engaged = _share(F.col("clicks") + F.col("types"))
    score = F.least(F.lit(1.0), variety * 0.4 + engaged * 0.4 + F.when(pace > 2, F.lit(0.2)).otherwise(F.lit(0.1)))
    return F.struct(
        rounded(score, 3).alias("consistency_score"),
        rounded(pace, 2).alias("actions_per_minute"),
        rounded(variety, 3).alias("action_diversity_ratio"),
        rounded(engaged, 3).alias("engagement_ratio"),
        F.col("clicks").alias("click_count"),
        F.col("scrolls").alias("scroll_count"),
        F.col("types").alias("type_count"),
        (F.lit("unknown") if label is None else F.coalesce(label, F.lit("unknown"))).alias("demographic_label"),
    )


def score_friction() -> Column:
    failures = F.col("n") - F.col("ok")
    return F.struct(
        failures.alias("total_failures"),
        rounded(_share(failures), 3).alias("failure_rate"),
        F.col("upset").alias("frustration_impressions"),
        F.col("stuck").alias("stuck_events"),
        rounded(_share(failures + F.col("upset")), 3).alias("friction_density"),
    )


def score_completeness() -> Column:
    success = _share(F.col("ok"))
    varied = F.col("kinds") >= 3
    rules = [F.col("n") >= 5, F.col("duration") >= 30, varied, success >= 0.5]
    score = sum((F.when(r, F.lit(0.25)).otherwise(F.lit(0.0)) for r in rules[1:]), F.when(rules[0], F.lit(0.25)).otherwise(F.lit(0.0)))
    return F.struct(
        score.alias("completeness_score"),
        F.col("n").alias("total_steps"),
        rounded(F.col("duration"), 1).alias("total_duration_s"),
        rounded(success, 3).alias("success_rate"),
        varied.alias("has_varied_actions"),
        (F.col("summaries") > 0).alias("has_session_summary"),
    )


def run_all_scorers(facts: DataFrame, label: Column | None = None) -> DataFrame:
    """Four score structs per session and the headline value of each."""
    scored = facts.select(
        "session_id",
        score_exploration().alias("exploration_coverage"),
        score_consistency(label).alias("demographic_consistency"),
        score_friction().alias("friction_detection"),
        score_completeness().alias("session_completeness"),
    )
    return scored.withColumns(
        {
            "exploration_headline": F.col("exploration_coverage.success_rate"),
            "consistency_headline": F.col("demographic_consistency.consistency_score"),
            "friction_headline": F.col("friction_detection.failure_rate"),
            "completeness_headline": F.col("session_completeness.completeness_score"),
        }
    )


# Score per signal, slowdown tiers, severity tiers and the wording of each reason.
FAILURE_POINTS, ERROR_POINTS, SLOW_MEAN_POINTS, SKIP_POINTS = 30, 25, 10, 5
SLOWDOWN_TIERS = [(5.0, 25, " — significant UI friction"), (3.0, 15, " — moderate friction"), (1.5, 5, "")]
SLOW_MEAN_S = 6
SEVERITY_TIERS = [(40, "critical"), (20, "high"), (10, "medium")]
FRICTION_REASONS = {
    "failure": " failure(s) — agent could not complete this action",
    "error": " error(s) encountered",
    "slowdown": "x slower than real user",
    "mean": "High average duration ({mean}s) — may indicate loading or rendering delays",
    "skipped": "x skipped (probability) — agent uncertain about interaction",
}
TIER_COLOURS = [(5.0, "red"), (3.0, "amber"), (1.5, "yellow")]


def friction_items(agent: DataFrame, deltas: DataFrame) -> DataFrame:
    """Friction score, reasons and severity per session and action, for every action performed.

    ``deltas`` is the timing comparison (``session_id, action_name, ratio``); actions without one
    have slowdown 0.  ``has_friction`` marks the rows the report lists.
    """
    grouped = agent.groupBy("session_id", "action_name").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.count_if(~F.col("success")).alias("failures"),
        F.count_if("skipped").alias("skipped"),
        F.sum(centis(F.col("duration_s"))).alias("_cs"),
    )
    rows = grouped.join(deltas.select("session_id", "action_name", "ratio"), ["session_id", "action_name"], "left").withColumns(
        {
            "slowdown": F.coalesce("ratio", F.lit(0.0)),
            "avg_duration_s": F.floor(F.col("_cs").cast("double") / F.col("occurrences") + F.lit(0.5)) / F.lit(100.0),
        }
    )
    slow, failures, skipped, mean = F.col("slowdown"), F.col("failures"), F.col("skipped"), F.col("avg_duration_s")

    def tiered(tiers, pick, default):
        out = None
        for bound, *rest in tiers:
            value = pick(*rest)
            out = F.when(slow >= bound, value) if out is None else out.when(slow >= bound, value)
        return out.otherwise(default)

    score = (
        failures * FAILURE_POINTS + failures * ERROR_POINTS
        + tiered(SLOWDOWN_TIERS, lambda points, _: F.lit(points), F.lit(0))
        + F.when(mean > SLOW_MEAN_S, F.lit(SLOW_MEAN_POINTS)).otherwise(F.lit(0))
        + skipped * SKIP_POINTS
    ).cast("long")
    count = failures.cast("string")
    reasons = F.array_compact(F.array(
        F.when(failures > 0, F.concat(count, F.lit(FRICTION_REASONS["failure"]))),
        F.when(failures > 0, F.concat(count, F.lit(FRICTION_REASONS["error"]))),
        tiered(SLOWDOWN_TIERS, lambda _, note: F.concat(fixed1(slow), F.lit(FRICTION_REASONS["slowdown"] + note)), F.lit(None)),
        F.when(mean > SLOW_MEAN_S, F.replace(F.lit(FRICTION_REASONS["mean"]), F.lit("{mean}"), fixed1(mean))),
        F.when(skipped > 0, F.concat(skipped.cast("string"), F.lit(FRICTION_REASONS["skipped"]))),
    ))
    severity = None
    for bound, name in SEVERITY_TIERS:
        severity = F.when(F.col("score") >= bound, F.lit(name)) if severity is None else severity.when(F.col("score") >= bound, F.lit(name))
    return (
        rows.withColumns({"score": score, "reasons": reasons})
        .withColumns({"severity": severity.otherwise(F.lit("low")), "has_friction": (F.col("score") > 0) | (slow > 1)})
        .select("session_id", "action_name", "occurrences", "failures", "skipped", "avg_duration_s", "slowdown", "score", "reasons", "severity", "has_friction")
    )


def heat_intensity(items: DataFrame) -> DataFrame:
    """Score of each action relative to the session's highest; 0 without any friction."""
    shown = F.when(F.col("has_friction"), F.col("score")).otherwise(F.lit(0))
    peaks = items.groupBy("session_id").agg(F.max(shown).alias("_peak"))
    return items.join(peaks, "session_id").withColumn(
        "intensity", F.when(F.col("_peak") > 0, rounded(shown / F.col("_peak"), 3)).otherwise(F.lit(0.0))
    ).drop("_peak")


def slowdown_rank(timings: DataFrame, deltas: DataFrame) -> DataFrame:
    """Actions of a session by slowdown: rank, colour tier and bar width; unmatched actions have no rank.

    A session has as many rows here as it has action kinds.
    """
    from pyspark.sql import Window

    rows = timings.join(deltas.select("session_id", "action_name", "real_user_avg_s", F.coalesce("ratio", F.lit(0.0)).alias("slowdown")),
                        ["session_id", "action_name"], "left").fillna(0.0, ["real_user_avg_s", "slowdown"])
    slow = F.col("slowdown")
    order = Window.partitionBy("session_id").orderBy(slow.desc())
    widest = F.max(slow).over(Window.partitionBy("session_id"))
    colour = None
    for bound, name in TIER_COLOURS:
        colour = F.when(slow >= bound, F.lit(name)) if colour is None else colour.when(slow >= bound, F.lit(name))
    return rows.withColumns(
        {
            "label": F.replace("action_name", F.lit("_"), F.lit(" ")),
            "rank": F.when(slow > 0, F.rank().over(order).cast("long")),
            "tier": F.when(slow > 0, colour.otherwise(F.lit("green"))),
            "bar_pct": F.when(slow > 0, rounded(F.least(slow / widest * 100.0, F.lit(100.0)))),
        }
    )


def overall_rollup(runs: DataFrame) -> DataFrame:
    """Per-cluster and grand totals (``cluster_id`` null) of actions and successes."""
    return (
        runs.rollup("cluster_id")
        .agg(F.count(F.lit(1)).alias("total_actions"), F.count_if("success").alias("total_success"))
        .withColumn("rate", F.coalesce(ratio(F.col("total_success"), F.col("total_actions")), F.lit(0.0)))
    )


def demographics_counts(people: DataFrame, columns: tuple[str, str] = ("age_group", "country")) -> DataFrame:
    """Number of people per value of each trait, ``?`` where unknown, most frequent first."""
    filled = people.select(*[F.coalesce(c, F.lit("?")).alias(c) for c in columns])
    first, second = columns
    is_first = F.grouping(first) == 0
    counted = filled.groupingSets([[first], [second]], first, second).agg(
        F.count(F.lit(1)).alias("people"), F.max(F.when(is_first, F.lit(first)).otherwise(F.lit(second))).alias("trait"))
    return counted.select("trait", F.coalesce(first, second).alias("value"), "people").orderBy("trait", F.desc("people"), "value")


def agent_cards(facts_history: DataFrame, impressions: DataFrame) -> DataFrame:
    """Success percentage and counts of frustrated and positive impressions per agent."""
    done = facts_history.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("ok"))
    felt = impressions.groupBy("session_id").agg(
        F.count_if(F.col("sentiment") == "frustration").alias("frustrations"), F.count_if(F.col("sentiment") == "positive").alias("positives"))
    return done.join(felt, "session_id", "left").fillna(0, ["frustrations", "positives"]).select(
        "session_id", rounded(F.col("ok") / F.col("n") * 100.0, 0).cast("long").alias("success_pct"), "frustrations", "positives")


def hero_stats(completion: DataFrame, deviation: DataFrame) -> DataFrame:
    """The headline numbers of a report."""
    speed = F.col("duration_ratio")
    return completion.join(deviation.select("session_id", "match_rate"), "session_id", "left").select(
        "session_id",
        F.concat(F.col("successful_actions").cast("string"), F.lit("/"), F.col("executed_actions").cast("string")).alias("completed"),
        rounded(F.col("completion_rate") * 100.0, 0).cast("long").alias("completion_pct"),
        rounded(F.col("match_rate") * 100.0, 0).cast("long").alias("match_pct"),
        F.when(speed < 1, F.lit("Agent faster than user")).otherwise(F.lit("Agent slower than user")).alias("speed_text"),
        F.when(speed > 1.5, F.lit("amber")).otherwise(F.lit("green")).alias("speed_tone"),
        F.when(F.col("total_errors") > 0, F.lit("red")).otherwise(F.lit("green")).alias("error_tone"),
    )
