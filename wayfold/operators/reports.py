"""Reports and prompt tables: joined aggregates rendered as text, one row per session and page.

Lists of unbounded length are cut into pages of ``PAGE_ROWS`` steps; a session that fits one page
has exactly one row, and the pages of a longer one together hold everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.exprs import fixed0, plain_seconds
from wayfold.functions.text import action_log_line
from wayfold.operators.agent import agent_log_line, best_per_key, last_k
from wayfold.operators.sequence import PAGE_ROWS, paged


def _n(c: str | Column, default: str = "N/A") -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(default))


def _number(c: str) -> Column:
    """Two-decimal number in its shortest form."""
    return F.coalesce(plain_seconds(F.col(c)), F.lit("N/A"))


def action_log(actions: DataFrame) -> DataFrame:
    """``(session_id, page, log)``: the lines of a session in order."""
    lines = actions.withColumn("_line", action_log_line()).filter(F.col("_line").isNotNull())
    return paged(lines, ["session_id"], "step", F.col("_line"), "_lines").select("session_id", "page", F.array_join("_lines", "\n").alias("log"))


def _rows_text(df: DataFrame, line: Column, order: str, name: str) -> DataFrame:
    """Lines of a bounded per-session table, joined in the given order."""
    item = F.struct(F.col(order).alias("o"), line.alias("l"))
    return df.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["l"]), "\n").alias(name))


def metric_table(completion: DataFrame) -> Column:
    rows = [("Planned actions", _n("planned_actions")), ("Executed", _n("executed_actions")), ("Successful", _n("successful_actions")),
            ("Failed", _n("failed_actions")), ("Completion rate", _number("completion_rate"))]
    return F.concat(F.lit("### Completion\n| Metric | Value |\n|---|---|\n"), F.concat_ws("\n", *[F.concat(F.lit(f"| {k} | "), v, F.lit(" |")) for k, v in rows]))


def _reason(stuck: DataFrame) -> Column:
    """Why an action was stuck; what only came too late has the reason ``Timeout``."""
    return F.coalesce("reason", F.lit("Timeout")) if "reason" in stuck.columns else F.lit("Timeout")


def _kinds(differences: DataFrame, which: str) -> Column:
    """Kinds of action under one difference, as sorted text; null where there are none."""
    found = F.array_sort(F.collect_set(F.when(F.col("difference") == which, F.col("action"))))
    return F.nullif(F.array_join(found, ", "), F.lit(""))


def markdown_report(
    completion: DataFrame, deltas: DataFrame, errors: DataFrame, stuck: DataFrame, deviation: DataFrame, differences: DataFrame,
    feedback: DataFrame, title: str = "Session feedback report",
) -> DataFrame:
    """``(session_id, page, markdown)``: metric tables of a session and its written feedback.

    ``completion`` is one row per session, ``deltas`` and ``errors`` one per action kind, ``differences`` one per
    missing or extra kind; ``feedback`` holds ``session_id, generated_at, feedback``, either may be null.  The list of
    stuck events (``reason`` is optional), which can be long, is what makes further pages.
    """
    timing = F.concat(
        F.lit("| "), "action_name", F.lit(" | "), _number("agent_avg_s"), F.lit("s | "), _number("real_user_avg_s"), F.lit("s | "),
        _number("delta_s"), F.lit("s | "), _number("ratio"), F.lit("x |"))
    timings = _rows_text(deltas, timing, "action_name", "_timing")
    faults = _rows_text(errors, F.concat(F.lit("- **"), "action_name", F.lit("**: "), "first_errors"), "action_name", "_errors")
    stops = paged(stuck, ["session_id"], "step",
                  F.concat(F.lit("- "), "action_name", F.lit(" at "), plain_seconds(F.col("relative_s")), F.lit("s: "), _reason(stuck)), "_stops")
    body = (
        completion.join(timings, "session_id", "left").join(faults, "session_id", "left")
        .join(deviation.select("session_id", "match_rate", "deviation_score"), "session_id", "left")
        .join(differences.groupBy("session_id").agg(_kinds(differences, "missing").alias("_missing"), _kinds(differences, "extra").alias("_extra")), "session_id", "left")
        .join(feedback.select("session_id", F.col("generated_at").cast("string").alias("_generated"), F.col("feedback").alias("_feedback")), "session_id", "left")
        .withColumn("page", F.lit(0).cast("long"))
        .join(stops, ["session_id", "page"], "full_outer")
    )
    listed = F.when(F.size("_stops") > 0, F.concat(F.lit("**Stuck events:**\n"), F.array_join("_stops", "\n")))
    first = F.concat_ws(
        "\n\n",
        F.concat(F.lit(f"# {title}\n**Session:** "), F.col("session_id").cast("string"), F.lit("\n**Generated:** "), F.coalesce("_generated", F.lit("unknown"))),
        F.lit("---\n\n## Quantitative Metrics"),
        metric_table(completion),
        F.concat(F.lit("### Timing\n| Metric | Value |\n|---|---|\n| Agent duration | "), _number("agent_duration_s"), F.lit("s |\n| Real user duration | "),
                 _number("real_user_duration_s"), F.lit("s |\n| Duration ratio | "), _number("duration_ratio"), F.lit("x |")),
        F.concat(F.lit("### Per-Action Timing Comparison\n| Action | Agent Avg | Real User Avg | Delta | Ratio |\n|---|---|---|---|---|\n"), F.col("_timing")),
        F.concat(F.lit("### Errors & Stuck Events\n- **Total errors:** "), _n("total_errors"), F.lit("\n- **Stuck events:** "), _n("total_stuck_events")),
        F.concat(F.lit("**Errors by action:**\n"), F.col("_errors")),
        listed,
        F.concat(F.lit("### Policy Deviation\n- **Match rate:** "), _number("match_rate"), F.lit("\n- **Deviation score:** "), _number("deviation_score"),
                 F.coalesce(F.concat(F.lit("\n- **Missing actions:** "), "_missing"), F.lit("")), F.coalesce(F.concat(F.lit("\n- **Extra actions:** "), "_extra"), F.lit(""))),
        F.concat(F.lit("---\n\n## Qualitative Feedback\n\n"), F.col("_feedback")),
    )
    return body.select("session_id", "page", F.when(F.col("executed_actions").isNotNull(), first).otherwise(listed).alias("markdown"))


def report_json(
    completion: DataFrame, deltas: DataFrame, errors: DataFrame, stuck: DataFrame, deviation: DataFrame, differences: DataFrame, engagement: DataFrame,
) -> DataFrame:
    """``(session_id, page, report)``: the same metrics as a JSON document, with ``engagement_counts``.

    As in Markdown, a very long list of stuck events goes on in further documents that hold nothing else.
    """
    kinds = {which: F.array_sort(F.collect_set(F.when(F.col("difference") == which, F.col("action")))) for which in ("missing", "extra")}
    apart = differences.groupBy("session_id").agg(*[x.alias(f"{which}_action_types") for which, x in kinds.items()])
    faults = errors.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("action_name", "first_errors"))).alias("errors_by_action"))
    details = paged(stuck, ["session_id"], "step", F.struct(F.col("action_name").alias("action"), "relative_s", _reason(stuck).alias("reason")), "stuck_details")
    per_action = deltas.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("action_name", "agent_avg_s", "real_user_avg_s", "delta_s", "ratio"))).alias("per_action_deltas"))
    joined = completion.join(per_action, "session_id", "left").join(deviation.drop("planned_length", "actual_length"), "session_id", "left")
    for more in (apart, faults, engagement):
        joined = joined.join(more, "session_id", "left")
    joined = joined.withColumn("page", F.lit(0).cast("long")).join(details, ["session_id", "page"], "full_outer")
    no_kinds = F.array().cast("array<string>")
    whole = F.to_json(F.struct(
        "session_id",
        F.struct("planned_actions", "executed_actions", "successful_actions", "failed_actions", "completion_rate").alias("completion"),
        F.struct("agent_duration_s", "real_user_duration_s", "duration_ratio", "per_action_deltas").alias("timing"),
        F.struct("total_errors", "total_stuck_events", "errors_by_action", "stuck_details").alias("errors"),
        F.struct("sequential_matches", "match_rate", "deviation_score", *[F.coalesce(c, no_kinds).alias(c) for c in ("missing_action_types", "extra_action_types")]).alias("deviation"),
        F.struct("agent_comments_written", "agent_votes_cast", "real_user_input_events", "real_user_click_events").alias("engagement")))
    rest = F.to_json(F.struct("session_id", F.struct("stuck_details").alias("errors")))
    return joined.select("session_id", "page", F.when(F.col("executed_actions").isNotNull(), whole).otherwise(rest).alias("report"))


# Prompt wording is a parameter; these defaults only name the task.
DESCRIBE_TASK = "Describe how this visitor behaves: navigation, reading, engagement, pace, typing and the arc of the session. Use only the log."
POLICY_TASK = "Turn the observed behaviour into a policy as one JSON object."
LABEL_TASK = "Name this group of visitors. Answer with JSON: label, description, key_behaviors."
NARRATIVE_TASK = "Report on the session in the first person, as this kind of visitor."
COMPARE_TASK = "Compare how these agents fared and name common and specific problems as JSON."
FEEDBACK_TASK = "Recommend improvements, each grounded in a metric or action below."


def _block(head: str, body: Column) -> Column:
    return F.concat(F.lit(f"{head}:\n"), body)


def describe_prompt(logs: DataFrame, profiles: DataFrame, durations: DataFrame, task: str = DESCRIBE_TASK) -> DataFrame:
    who = F.concat(F.lit("- Age group: "), _n("age_group", "unknown"), F.lit("\n- Country: "), _n("country", "unknown"),
                   F.lit("\n- Device: "), _n("device_type", "unknown"), F.lit(", "), _n("browser", "unknown"), F.lit(" on "), _n("os", "unknown"))
    rows = logs.join(profiles, "session_id", "left").join(durations, "session_id", "left")
    return rows.select("session_id", "page", F.concat_ws(
        "\n\n", F.lit(task), _block("USER PROFILE", who), F.concat(F.lit("SESSION DURATION: "), _number("session_duration_s"), F.lit(" seconds")),
        _block("ACTION LOG", F.col("log"))).alias("prompt"))


def policy_prompt(descriptions: DataFrame, profiles: DataFrame, task: str = POLICY_TASK) -> DataFrame:
    traits = F.to_json(F.struct(*[c for c in profiles.columns if c != "session_id"]))
    return descriptions.join(profiles, "session_id", "left").select("session_id", F.concat_ws(
        "\n\n", F.lit(task), _block("USER PROFILE", traits), _block("OBSERVED BEHAVIOUR", F.col("text"))).alias("prompt"))


def label_prompt(stats: DataFrame, excerpts: DataFrame, cluster: str, task: str = LABEL_TASK) -> DataFrame:
    """``stats`` is ``cluster_profile`` (size, means, traits, distributions), ``excerpts`` its first members (``rank, excerpt``)."""
    def spread(c: str) -> Column:
        """Counts by value, in the order of the values."""
        entries = F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string, bigint>"))))
        return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), ", "), F.lit("}"))

    item = F.struct("rank", F.concat(F.lit("--- User "), F.col("rank").cast("string"), F.lit(" ---\n"), "excerpt").alias("e"))
    samples = excerpts.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["e"]), "\n").alias("_samples"))
    facts = F.concat(
        F.lit("- Users: "), F.col("size").cast("string"), F.lit("\n- Dominant age group: "), _n("age_group", "unknown"), F.lit("\n- Dominant country: "), _n("country", "unknown"),
        F.lit("\n- NYC familiarity: "), _n("nyc_familiarity", "unknown"), F.lit("\n- Average session duration: "), _number("avg_duration_s"),
        F.lit("s\n- Average actions per session: "), _number("avg_actions"),
        F.lit("\n- Age distribution: "), spread("age_distribution"), F.lit("\n- Country distribution: "), spread("country_distribution"))
    return stats.join(samples, cluster, "left").select(cluster, F.concat_ws(
        "\n\n", F.lit(task), _block("CLUSTER STATS", facts), _block("SAMPLE DESCRIPTIONS", F.coalesce("_samples", F.lit("")))).alias("prompt"))


NARRATIVE_ACTIONS, COMPARED_IMPRESSIONS, NARRATIVE_CHARS, DESCRIPTION_CHARS = 20, 5, 800, 2000


def narrative_prompt(agent: DataFrame, impressions: DataFrame, profiles: DataFrame, summary: DataFrame, target: str = "?", task: str = NARRATIVE_TASK) -> DataFrame:
    """Profile and summary, first actions of the session and its impressions, per page of impressions.

    ``profiles`` has ``session_id, age_group, country, nyc_familiarity, description``; ``summary`` is ``session_summary``.
    """
    who = F.concat(F.lit("- Age group: "), _n("age_group", "unknown"), F.lit("\n- Country: "), _n("country", "unknown"),
                   F.lit("\n- NYC familiarity: "), _n("nyc_familiarity", "unknown"), F.lit("\n- Behavioral style: "), _n("description", ""))
    facts = F.concat(F.lit(f"- Target app: {target}\n- Duration: "), F.coalesce(fixed0(F.col("total_duration_s")), F.lit("0")), F.lit("s\n- Steps taken: "), _n("total_actions", "0"),
                     F.lit("\n- Successful: "), _n("successful_actions", "0"), F.lit("\n- Failed: "), _n("failed_actions", "0"))
    status = F.when(F.col("success"), F.lit("OK")).otherwise(F.concat(F.lit("FAILED: "), F.substring("error", 1, 50)))
    line = F.concat(F.lit("  ["), plain_seconds(F.col("relative_s")), F.lit("s] "), "action_name", F.lit(" on "), F.substring("target", 1, 40), F.lit(" - "), status)
    first = _rows_text(best_per_key(agent, ["session_id"], [F.col("step")], NARRATIVE_ACTIONS), line, "step", "_actions")
    felt = F.concat(F.lit("  ["), plain_seconds(F.col("elapsed_s")), F.lit("s] ("), "sentiment", F.lit(") "), F.substring("context", 1, 80))
    item = F.struct("step", F.when(F.col("sentiment") == "summary", 1).otherwise(0).alias("o"), felt.alias("l"))
    pages = impressions.groupBy("session_id", F.floor((F.col("step") - 1) / F.lit(PAGE_ROWS)).cast("long").alias("page")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["l"]), "\n").alias("_felt"))
    rows = pages.join(first, "session_id", "left").join(profiles, "session_id", "left").join(summary, "session_id", "left")
    return rows.select("session_id", "page", F.concat_ws(
        "\n\n", F.lit(task), _block("DEMOGRAPHIC PROFILE", who), _block("SESSION SUMMARY", facts),
        _block("ACTION LOG", F.coalesce("_actions", F.lit(""))), _block("IMPRESSIONS", F.col("_felt"))).alias("prompt"))


def agent_sections(summary: DataFrame, narratives: DataFrame, impressions: DataFrame, labels: DataFrame) -> DataFrame:
    """``(session_id, section)``: what the comparison says about one agent; ``labels`` is ``(session_id, label)``."""
    counted = impressions.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n_felt"))
    first = best_per_key(impressions, ["session_id"], [F.col("step"), F.col("sentiment")], COMPARED_IMPRESSIONS, rank="_r")
    felt = _rows_text(first, F.concat(F.lit("  ["), "sentiment", F.lit("] "), F.substring("context", 1, 80)), "_r", "_felt")
    rows = summary
    for part in (narratives, felt, counted, labels):
        rows = rows.join(part, "session_id", "left")
    return rows.select("session_id", F.concat_ws(
        "\n",
        F.concat(F.lit("--- Agent "), F.col("session_id").cast("string"), F.coalesce(F.concat(F.lit(": "), "label"), F.lit("")), F.lit(" ---")),
        F.concat(F.lit("Steps: "), F.col("total_actions").cast("string"), F.lit(", Duration: "), fixed0(F.col("total_duration_s")), F.lit("s")),
        F.concat(F.lit("Successful: "), F.col("successful_actions").cast("string"), F.lit(", Failed: "), F.col("failed_actions").cast("string")),
        F.concat(F.lit("Impressions: "), _n("_n_felt", "0")),
        F.concat(F.lit("Narrative: "), F.coalesce(F.substring("narrative", 1, NARRATIVE_CHARS), F.lit(""))),
        F.col("_felt")).alias("section"))


def comparative_prompt(sections: DataFrame, runs: DataFrame, task: str = COMPARE_TASK) -> DataFrame:
    """One prompt a run with the sections of its agents; ``runs`` is ``(session_id, run_id)``, ids of any type."""
    item = F.struct("session_id", "section")
    return sections.join(runs, "session_id").groupBy("run_id").agg(
        F.concat(F.lit(task + "\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["section"]), "\n\n")).alias("prompt"))


LAST_ACTIONS = 20


def feedback_prompt(completion: DataFrame, errors: DataFrame, deltas: DataFrame, agent: DataFrame, stuck: DataFrame, deviation: DataFrame, descriptions: DataFrame, task: str = FEEDBACK_TASK) -> DataFrame:
    """Metrics, first errors per action, slowdowns, stuck events and the last actions of a session.

    Stuck events are at least a time-out apart, so that a session has at most its length over the time-out of them.
    """
    why = _n("reason", "Timeout") if "reason" in stuck.columns else F.lit("Timeout")
    stop = F.concat(F.lit("  - Stuck at "), _n("action_name", "?"), F.lit(" ("), why, F.lit(") on "), F.coalesce(F.nullif("page_url", F.lit("")), F.lit("?")))
    stops = _rows_text(stuck, stop, "step", "_stops")
    pace = F.concat(F.lit("  - Agent session duration: "), _number("agent_duration_s"), F.lit("s\n  - Real user session duration: "), _number("real_user_duration_s"),
                    F.lit("s\n  - Duration ratio: "), _number("duration_ratio"), F.lit("x"))
    totals = F.concat(F.lit("  - Total errors: "), _n("total_errors"), F.lit("\n  - Stuck events: "), _n("total_stuck_events"))
    drift = F.concat(F.lit("  - Match rate: "), _number("match_rate"), F.lit("\n  - Deviation score: "), _number("deviation_score"))
    faults = _rows_text(errors, F.concat(F.lit("  - "), "action_name", F.lit(": "), "first_errors"), "action_name", "_errors")
    timing = F.concat(F.lit("  - "), "action_name", F.lit(": agent "), _number("agent_avg_s"), F.lit("s vs real user "), _number("real_user_avg_s"),
                      F.lit("s (ratio: "), _number("ratio"), F.lit("x)"))
    slow = _rows_text(deltas, timing, "action_name", "_timing")
    tail = _rows_text(last_k(agent, ["session_id"], "step", LAST_ACTIONS), agent_log_line(), "step", "_tail")
    rows = completion
    rates = deviation.select("session_id", "match_rate", "deviation_score")
    for part in (faults, slow, tail, stops, rates, descriptions.select("session_id", F.substring("text", 1, DESCRIPTION_CHARS).alias("_who"))):
        rows = rows.join(part, "session_id", "left")
    return rows.select("session_id", F.concat_ws(
        "\n\n", F.lit(task), _block("PROFILE", F.coalesce("_who", F.lit(""))), metric_table(completion), _block("TIMING", F.concat_ws("\n", pace, "_timing")),
        _block("ERRORS", F.concat_ws("\n", totals, "_errors")), _block("STUCK EVENTS", F.coalesce("_stops", F.lit("  None"))), _block("POLICY DEVIATION", drift),
        _block("LAST ACTIONS", F.coalesce("_tail", F.lit("  None")))).alias("prompt"))
