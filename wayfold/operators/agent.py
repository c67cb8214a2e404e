"""Agent logs: summaries, comparison with real sessions, streaks, stuck points and impressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.exprs import centis, fixed0, plain_seconds, ratio, rounded
from wayfold.operators.sequence import Sequence, best_per_key, paged, with_lookback

# Which agent action a real action kind is compared with.
REAL_TO_AGENT = {"CLICK": "open_post", "TYPE": "write_comment", "SCROLL": "scan_feed"}

MAX_CONSECUTIVE_ERRORS = 3
STUCK_TIMEOUT_S = 15
IMPRESSION_EVERY = 5


def mean_seconds(total_centis: Column, rows: Column) -> Column:
    """Mean of two-decimal seconds, rounded to two decimals, from an exact integer sum."""
    return F.floor(F.try_divide(total_centis.cast("double"), rows) + F.lit(0.5)) / F.lit(100.0)


def session_summary(agent: DataFrame, stuck: DataFrame | None = None) -> DataFrame:
    """Totals of each logged session; its ordered action list is ``action_pages``."""
    totals = agent.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_actions"),
        F.count_if("success").alias("successful_actions"),
        F.count_if(~F.col("success")).alias("failed_actions"),
        F.max("relative_s").alias("total_duration_s"),
    )
    if stuck is not None:
        counts = stuck.groupBy("session_id").agg(F.count(F.lit(1)).alias("stuck_events"))
        totals = totals.join(counts, "session_id", "left")
    else:
        totals = totals.withColumn("stuck_events", F.lit(0).cast("long"))
    return totals.withColumns(
        {
            "stuck_events": F.coalesce("stuck_events", F.lit(0)),
            "error_count": F.col("failed_actions"),
            "completion_rate": F.coalesce(ratio(F.col("successful_actions"), F.col("total_actions")), F.lit(0.0)),
        }
    )


def action_pages(agent: DataFrame) -> DataFrame:
    """Executed action names in order, in lists of bounded length."""
    return paged(agent, ["session_id"], "step", F.col("action_name"), "action_sequence")


def avg_action_timings(agent: DataFrame) -> DataFrame:
    return (
        agent.groupBy("session_id", "action_name")
        .agg(F.sum(centis(F.col("duration_s"))).alias("_cs"), F.count(F.lit(1)).alias("n"))
        .select("session_id", "action_name", mean_seconds(F.col("_cs"), F.col("n")).alias("agent_avg_s"), "n")
    )


def timings_map(timings: DataFrame) -> DataFrame:
    """The timings of a session as one map; there are as many entries as action kinds."""
    pair = F.struct("action_name", "agent_avg_s")
    return timings.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("avg_action_timings"))


def real_action_timings(actions: DataFrame) -> DataFrame:
    """Mean gap before each compared kind of real action; the action before may be of any kind."""
    mapped = F.create_map(*[F.lit(x) for pair in REAL_TO_AGENT.items() for x in pair])[F.col("action")]
    gaps = with_lookback(actions.select("session_id", "step", "time", mapped.alias("action_name")), ["session_id"], "step", 1,
                         lambda w: {"_prev": F.lag("time").over(w)})
    gap = centis(F.col("time")) - centis(F.col("_prev"))
    return (
        gaps.filter(F.col("action_name").isNotNull() & (F.col("_prev") > 0) & (gap > 0))
        .groupBy("session_id", "action_name")
        .agg(F.sum(gap).alias("_cs"), F.count(F.lit(1)).alias("_n"))
        .select("session_id", "action_name", mean_seconds(F.col("_cs"), F.col("_n")).alias("real_user_avg_s"))
    )


def timing_deltas(agent_timings: DataFrame, real_timings: DataFrame) -> DataFrame:
    """Agent against real user for the actions both performed."""
    a, r = F.col("agent_avg_s"), F.col("real_user_avg_s")
    return agent_timings.join(real_timings, ["session_id", "action_name"]).select(
        "session_id", "action_name", a, r,
        ((centis(a + 1_000_000) - centis(r + 1_000_000)) / F.lit(100.0)).alias("delta_s"),
        F.when(r > 0, ratio(a, r)).alias("ratio"),
    )


def errors_by_action(agent: DataFrame) -> DataFrame:
    """Messages of failed actions per action, in order, in lists of bounded length."""
    failed = agent.filter(~F.col("success")).withColumn("action_name", F.coalesce("action_name", F.lit("unknown")))
    return paged(failed, ["session_id", "action_name"], "step", F.col("error"), "errors")


def top_errors(agent: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` messages per action, joined for a prompt or report."""
    first = best_per_key(agent.filter(~F.col("success")), ["session_id", "action_name"], [F.col("step")], k)
    item = F.struct("rank", "error")
    return first.groupBy("session_id", "action_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["error"]), ", ").alias("first_errors")
    )


def engagement_counts(actions: DataFrame, agent: DataFrame) -> DataFrame:
    kind, done = F.col("action"), F.col("success") & ~F.coalesce("skipped", F.lit(False))
    counts = ["real_user_click_events", "real_user_input_events", "real_user_api_calls"]
    real = actions.groupBy("session_id").agg(
        F.count_if(kind == "CLICK").alias("real_user_click_events"),
        F.count_if(kind == "TYPE").alias("real_user_input_events"),
        F.count_if(kind == "API_CALL").alias("real_user_api_calls"),
    )
    logged = agent.groupBy("session_id").agg(
        F.count_if((F.col("action_name") == "write_comment") & done).alias("agent_comments_written"),
        F.count_if((F.col("action_name") == "vote_on_post") & done).alias("agent_votes_cast"),
    )
    return logged.join(real, "session_id", "left").fillna(0, counts)


def completion_block(summary: DataFrame, planned: DataFrame, real: DataFrame) -> DataFrame:
    """``planned(session_id, planned_actions)`` and ``real(session_id, real_user_duration_s)`` meet the log summary."""
    rate = ratio(F.col("total_duration_s"), F.col("real_user_duration_s"))
    return (
        summary.join(planned, "session_id", "left")
        .join(real, "session_id", "left")
        .select(
            "session_id",
            F.coalesce("planned_actions", F.lit(0)).alias("planned_actions"),
            F.col("total_actions").alias("executed_actions"),
            "successful_actions",
            "failed_actions",
            "completion_rate",
            F.col("total_duration_s").alias("agent_duration_s"),
            "real_user_duration_s",
            F.when(F.col("real_user_duration_s") > 0, rate).otherwise(F.lit(0.0)).alias("duration_ratio"),
            F.col("error_count").alias("total_errors"),
            F.col("stuck_events").alias("total_stuck_events"),
        )
    )


def positional_match(planned: DataFrame, actual: DataFrame) -> DataFrame:
    """Both inputs are ``(session_id, pos, action)``; equal actions at equal positions are matches.

    The join key is the pair ``(session, position)``, so a long session spreads over all tasks.
    """
    both = planned.select("session_id", "pos", F.col("action").alias("_want")).join(
        actual.select("session_id", "pos", F.col("action").alias("_did")), ["session_id", "pos"], "full_outer"
    )
    counts = both.groupBy("session_id").agg(
        F.count("_want").alias("planned_length"),
        F.count("_did").alias("actual_length"),
        F.count_if(F.col("_want") == F.col("_did")).alias("sequential_matches"),
    )
    matched = ratio(F.col("sequential_matches"), F.col("planned_length"))
    return counts.withColumn("match_rate", matched).withColumn(
        "deviation_score", F.coalesce(F.lit(1.0) - F.col("match_rate"), F.lit(0.0))
    ).withColumn("deviation_score", rounded(F.col("deviation_score")))


def sequence_differences(planned: DataFrame, actual: DataFrame) -> DataFrame:
    """Action kinds planned but never executed (``missing``) and the reverse (``extra``)."""
    want = planned.select("session_id", "action").distinct()
    did = actual.select("session_id", "action").distinct()
    missing = want.join(did, ["session_id", "action"], "left_anti").withColumn("difference", F.lit("missing"))
    extra = did.join(want, ["session_id", "action"], "left_anti").withColumn("difference", F.lit("extra"))
    return missing.unionByName(extra)


def error_streak(agent: DataFrame, limit: int = MAX_CONSECUTIVE_ERRORS) -> DataFrame:
    """Adds ``streak`` (consecutive failures, starting over after ``limit``) and ``recovery``.

    Inside a run of failures the count is a closed form of the distance to the last success.
    """
    ordered = Sequence(agent, ["session_id"], ["step"])
    rows = ordered.last_known("_ok", F.when(F.col("success"), F.col("step"))).build()
    run = F.col("step") - F.coalesce("_ok", F.lit(0))
    streak = F.when(F.col("success"), F.lit(0)).otherwise(F.pmod(run - 1, F.lit(limit)) + 1).cast("long")
    return rows.withColumn("streak", streak).withColumn("recovery", F.col("streak") == limit).drop("_ok")


def error_context(streaks: DataFrame) -> DataFrame:
    """Adds ``error_context``: the message of the failure before, unless recovery followed it."""
    def columns(w):
        return {"_failed": F.lag(F.struct("streak", "recovery", "error")).over(w)}

    rows = with_lookback(streaks, ["session_id"], "step", 1, columns)
    open_failure = (F.col("_failed.streak") > 0) & ~F.col("_failed.recovery")
    return rows.withColumn("error_context", F.when(open_failure, F.col("_failed.error")).otherwise(F.lit(""))).drop("_failed")


def stuck_points(agent: DataFrame, timeout_s: float = STUCK_TIMEOUT_S) -> DataFrame:
    """Actions that came later than ``timeout_s`` after the one before."""
    rows = with_lookback(agent, ["session_id"], "step", 1, lambda w: {"_prev": F.lag("relative_s").over(w)})
    gap = (centis(F.col("relative_s")) - centis(F.col("_prev"))) / F.lit(100.0)
    return rows.withColumn("gap_s", gap).filter(F.col("gap_s") > timeout_s).drop("_prev")


def execution_trace(spans: DataFrame) -> DataFrame:
    """``(session_id, order_key, started_us, ended_us)`` -> start relative to the session and duration, in seconds."""
    rows = Sequence(spans, ["session_id"], ["started_us", "order_key"]).number("step").first("_t0", F.col("started_us")).build()
    hundredth = F.lit(10_000.0)
    return rows.withColumns(
        {
            "relative_s": F.floor((F.col("started_us") - F.col("_t0")) / hundredth + F.lit(0.5)) / F.lit(100.0),
            "duration_s": F.floor((F.col("ended_us") - F.col("started_us")) / hundredth + F.lit(0.5)) / F.lit(100.0),
        }
    ).drop("_t0")


def timeline(agent: DataFrame, totals: DataFrame) -> DataFrame:
    """Where each action sits on a percent axis; ``totals`` is ``(session_id, total_duration_s)``."""
    total = F.col("total_duration_s")
    length = F.coalesce(F.nullif("duration_s", F.lit(0.0)), F.lit(0.5))
    return agent.join(totals, "session_id").withColumns(
        {
            "left_pct": rounded(F.try_divide(F.col("relative_s"), total) * 100.0),
            "width_pct": F.greatest(rounded(F.try_divide(length, total) * 100.0), F.lit(0.8)),
        }
    )


def impressions(agent: DataFrame) -> DataFrame:
    """Failed steps leave ``frustration``, every fifth other step ``neutral``, the end of a session ``summary``."""
    place = F.coalesce(F.nullif("page_url", F.lit("")), F.lit("unknown"))
    failed = ~F.col("success")
    context = F.when(
        failed,
        F.concat(F.lit("Failed to "), "action_name", F.lit(" on "), F.substring("target", 1, 50), F.lit(": "), F.substring("error", 1, 100)),
    ).otherwise(F.concat(F.lit("After "), F.col("step").cast("string"), F.lit(" actions, currently at "), place))
    during = agent.filter(failed | (F.pmod("step", F.lit(IMPRESSION_EVERY)) == 0)).select(
        "session_id", "step", F.col("relative_s").alias("elapsed_s"), context.alias("context"),
        F.when(failed, F.lit("frustration")).otherwise(F.lit("neutral")).alias("sentiment"), place.alias("url"))
    ends = agent.groupBy("session_id").agg(
        F.max("step").alias("step"), F.max_by("relative_s", "step").alias("elapsed_s"), F.max_by(place, "step").alias("url"))
    final = ends.select(
        "session_id", "step", "elapsed_s",
        F.concat(F.lit("Session complete after "), F.col("step").cast("string"), F.lit(" steps, "), fixed0(F.col("elapsed_s")), F.lit("s")).alias("context"),
        F.lit("summary").alias("sentiment"), "url")
    return during.unionByName(final)


def last_k(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """Newest ``k`` rows per key."""
    return best_per_key(df, keys, [F.col(order).desc()], k)


def agent_log_line(details: Column | None = None) -> Column:
    """``[t] action - OK/FAILED (d)`` with the error and short details of the row."""
    status = F.when(F.col("success"), F.lit("OK")).otherwise(F.lit("FAILED"))
    error = F.when(~F.col("success"), F.concat(F.lit(" ERROR: "), F.coalesce("error", F.lit("")))).otherwise(F.lit(""))
    line = F.concat(F.lit("  ["), plain_seconds(F.col("relative_s")), F.lit("s] "), "action_name", F.lit(" - "), status,
                    F.lit(" ("), plain_seconds(F.col("duration_s")), F.lit("s)"), error)
    if details is None:
        return line
    return F.concat(line, F.when(F.length(details) < 100, F.concat(F.lit(" "), details)).otherwise(F.lit("")))


def action_label(name: Column, details: Column) -> Column:
    """Readable label of an action from its details (JSON text)."""
    def field(key: str) -> Column:
        return F.nullif(F.get_json_object(details, f"$.{key}"), F.lit(""))

    skipped = F.coalesce(field("skipped") == "true", F.lit(False))
    written = F.concat(F.lit("Wrote comment ("), F.coalesce(F.nullif(field("comment_length"), F.lit("0")), F.lit("?")), F.lit(" chars)"))
    return (
        F.when(name == "signup", F.coalesce(F.concat(F.lit("Signed up as "), field("username")), F.lit("Signed up")))
        .when(name == "open_post", F.coalesce(F.concat(F.lit('Opened "'), field("post_title"), F.lit('"')), F.lit("Opened a post")))
        .when(name == "write_comment", F.when(skipped, F.lit("Comment skipped (probability)")).otherwise(written))
        .when(name == "vote_on_post", F.when(skipped, F.lit("Vote skipped (probability)")).otherwise(F.lit("Voted on post")))
        .when(name == "browse_subreddit", F.coalesce(F.concat(F.lit("Browsed r/"), field("subreddit")), F.lit("Browsed subreddit")))
        .when(name == "create_post", F.lit("Created a post"))
        .when(name == "scan_feed", F.concat(F.lit("Scanned feed ("), F.coalesce(field("pattern"), F.lit("default")), F.lit(")")))
        .when(name == "return_to_feed", F.lit("Returned to feed"))
        .otherwise(name)
    )
