"""Queries over agent logs: metrics against real sessions, streaks, scores and dashboard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions.exprs import centis
from wayfold.operators import agent as A
from wayfold.operators import scoring as SC
from wayfold.plans import bindings as B
from wayfold.plans.q_training import f0, f1
from wayfold.plans.registry import query

AGENT = "WITH " + B.AGENT_SQL
BOTH = "WITH " + B.ACTIONS_SQL + "," + B.AGENT_SQL[len(B.EVENTS_SQL) + 1:]
STUCK_S = 21_600.0

SUMMARY = """,
stuck AS (
  SELECT * FROM (SELECT *, (floor(relative_s * 100 + 0.5) - floor(lag(relative_s) OVER (PARTITION BY session_id ORDER BY step) * 100 + 0.5)) / 100 AS gap_s FROM agent)
  WHERE gap_s > 21600),
summary AS (
  SELECT a.*, coalesce(s.n, 0) AS stuck_events FROM (
    SELECT session_id, count(*) AS total_actions, count(*) FILTER (WHERE success) AS successful_actions, count(*) FILTER (WHERE NOT success) AS failed_actions,
      max(relative_s) AS total_duration_s, count(*) FILTER (WHERE NOT success) AS error_count,
      floor(count(*) FILTER (WHERE success) / count(*)::DOUBLE * 100 + 0.5) / 100 AS completion_rate
    FROM agent GROUP BY 1) a LEFT JOIN (SELECT session_id, count(*) AS n FROM stuck GROUP BY 1) s USING (session_id))"""
TIMINGS = """,
timings AS (
  SELECT session_id, action_name, floor(sum(floor(duration_s * 100 + 0.5)::BIGINT)::DOUBLE / count(*) + 0.5) / 100 AS agent_avg_s, count(*) AS n
  FROM agent GROUP BY 1, 2),
gaps AS (
  SELECT session_id, CASE action WHEN 'CLICK' THEN 'open_post' WHEN 'TYPE' THEN 'write_comment' WHEN 'SCROLL' THEN 'scan_feed' END AS action_name,
    lag("time") OVER (PARTITION BY session_id ORDER BY step) AS prev,
    floor("time" * 100 + 0.5)::BIGINT - floor(lag("time") OVER (PARTITION BY session_id ORDER BY step) * 100 + 0.5)::BIGINT AS gap
  FROM actions),
real_timings AS (
  SELECT session_id, action_name, floor(sum(gap)::DOUBLE / count(*) + 0.5) / 100 AS real_user_avg_s
  FROM gaps WHERE action_name IS NOT NULL AND prev > 0 AND gap > 0 GROUP BY 1, 2),
deltas AS (
  SELECT session_id, action_name, agent_avg_s, real_user_avg_s,
    (floor(agent_avg_s * 100 + 0.5) - floor(real_user_avg_s * 100 + 0.5)) / 100 AS delta_s,
    CASE WHEN real_user_avg_s > 0 THEN floor(agent_avg_s / real_user_avg_s * 100 + 0.5) / 100 END AS ratio
  FROM timings JOIN real_timings USING (session_id, action_name))"""


def _stuck(t):
    return A.stuck_points(B.stored_agent_log(t), STUCK_S)


def _summary(t):
    return A.session_summary(B.stored_agent_log(t), _stuck(t))


def _deltas(t):
    """Timing comparison with the agent's clock slowed to the scale of the driver's data."""
    return A.timing_deltas(A.avg_action_timings(B.stored_agent_log(t)), A.real_action_timings(B.stored_actions(t)))


@query("session_summary", AGENT + SUMMARY + "SELECT * FROM summary")
def session_summary(t):
    return _summary(t)


@query("action_pages", AGENT + """SELECT session_id, (step - 1) // 10000 AS page, string_agg(action_name, ',' ORDER BY step) AS action_sequence
FROM agent GROUP BY 1, 2""")
def action_pages(t):
    return A.action_pages(B.agent_actions(t)).withColumn("action_sequence", F.array_join("action_sequence", ","))


@query("avg_action_timings", BOTH + TIMINGS + "SELECT * FROM timings")
def avg_action_timings(t):
    return A.avg_action_timings(B.agent_actions(t))


@query("real_action_timings", BOTH + TIMINGS + "SELECT * FROM real_timings")
def real_action_timings(t):
    return A.real_action_timings(B.actions(t))


@query("timing_deltas", BOTH + TIMINGS + "SELECT * FROM deltas")
def timing_deltas(t):
    return _deltas(t)


@query("errors_by_action", AGENT + """SELECT session_id, action_name, (step - 1) // 10000 AS page, string_agg(error, '|' ORDER BY step) AS errors
FROM agent WHERE NOT success GROUP BY 1, 2, 3""")
def errors_by_action(t):
    return A.errors_by_action(B.agent_actions(t)).withColumn("errors", F.array_join("errors", "|"))


@query("top_errors", AGENT + """SELECT session_id, action_name, string_agg(error, ', ' ORDER BY step) AS first_errors
FROM (SELECT *, row_number() OVER (PARTITION BY session_id, action_name ORDER BY step) AS rn FROM agent WHERE NOT success) WHERE rn <= 3 GROUP BY 1, 2""")
def top_errors(t):
    return A.top_errors(B.agent_actions(t))


@query("engagement_counts", BOTH + """
SELECT * FROM (SELECT session_id, count(*) FILTER (WHERE action = 'CLICK') AS real_user_click_events, count(*) FILTER (WHERE action = 'TYPE') AS real_user_input_events,
    count(*) FILTER (WHERE action = 'API_CALL') AS real_user_api_calls FROM actions GROUP BY 1)
JOIN (SELECT session_id, count(*) FILTER (WHERE action_name = 'write_comment' AND success AND NOT skipped) AS agent_comments_written,
    count(*) FILTER (WHERE action_name = 'vote_on_post' AND success AND NOT skipped) AS agent_votes_cast FROM agent GROUP BY 1) USING (session_id)""")
def engagement_counts(t):
    return A.engagement_counts(B.action_kinds(t), B.agent_actions(t))


COMPLETION = """,
completion AS (
  SELECT session_id, coalesce(p.n, 0) AS planned_actions, total_actions AS executed_actions, successful_actions, failed_actions, completion_rate,
    total_duration_s AS agent_duration_s, r.d AS real_user_duration_s,
    CASE WHEN r.d > 0 THEN floor(total_duration_s / r.d * 100 + 0.5) / 100 ELSE 0 END AS duration_ratio,
    error_count AS total_errors, stuck_events AS total_stuck_events
  FROM summary LEFT JOIN (SELECT session_id + 1 AS session_id, count(*) AS n FROM ev GROUP BY 1) p USING (session_id)
  LEFT JOIN (SELECT session_id + 1 AS session_id, max(relative_s) AS d FROM agent GROUP BY 1) r USING (session_id))"""
DEVIATION = """,
actual AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY us, event_id) AS pos, event_type AS action FROM ev),
planned AS (SELECT session_id + 1 AS session_id, pos, action FROM actual),
counts AS (
  SELECT session_id, count(p.action) AS planned_length, count(a.action) AS actual_length, count(*) FILTER (WHERE p.action = a.action) AS sequential_matches
  FROM planned p FULL JOIN actual a USING (session_id, pos) GROUP BY 1),
rated AS (SELECT *, CASE WHEN planned_length > 0 THEN floor(sequential_matches / planned_length::DOUBLE * 100 + 0.5) / 100 END AS match_rate FROM counts),
deviation AS (SELECT *, floor(coalesce(1 - match_rate, 0) * 100 + 0.5) / 100 AS deviation_score FROM rated)"""


def _completion(t):
    planned = B.action_kinds(t).groupBy((F.col("session_id") + 1).alias("session_id")).agg(F.count(F.lit(1)).alias("planned_actions"))
    real = B.stored_agent_log(t).groupBy((F.col("session_id") + 1).alias("session_id")).agg(F.max("relative_s").alias("real_user_duration_s"))
    return A.completion_block(_summary(t), planned, real)


@query("completion_block", AGENT + SUMMARY + COMPLETION + "SELECT * FROM completion")
def completion_block(t):
    return _completion(t)


@query("positional_match", AGENT + DEVIATION + "SELECT * FROM deviation")
def positional_match(t):
    return A.positional_match(*B.agent_sequences(t))


@query("sequence_differences", AGENT + """,
w AS (SELECT DISTINCT session_id + 1 AS session_id, event_type || (k % 7) AS action FROM ev), d AS (SELECT DISTINCT session_id, event_type || (k % 7) AS action FROM ev)
SELECT *, 'missing' AS difference FROM (SELECT * FROM w EXCEPT SELECT * FROM d) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM d EXCEPT SELECT * FROM w)""")
def sequence_differences(t):
    did = B.events(t).select("session_id", F.concat("event_type", F.pmod("k", F.lit(7)).cast("string")).alias("action"))
    return A.sequence_differences(did.withColumn("session_id", F.col("session_id") + 1), did)


STREAK = """,
oks AS (SELECT *, coalesce(max(CASE WHEN success THEN step END) OVER (PARTITION BY session_id ORDER BY step), 0) AS ok FROM agent),
streaks AS (SELECT *, CASE WHEN success THEN 0 ELSE (step - ok - 1) % 3 + 1 END AS streak FROM oks),
ctx AS (SELECT *, streak = 3 AS recovery, lag(streak) OVER (PARTITION BY session_id ORDER BY step) AS pstreak, lag(error) OVER (PARTITION BY session_id ORDER BY step) AS perror FROM streaks)"""


@query("error_streak", AGENT + STREAK + "SELECT session_id, step, streak::BIGINT AS streak, recovery FROM ctx")
def error_streak(t):
    return A.error_streak(B.stored_agent_log(t)).select("session_id", "step", "streak", "recovery")


@query("error_context", AGENT + STREAK + "SELECT session_id, step, CASE WHEN pstreak > 0 AND pstreak <> 3 THEN perror ELSE '' END AS error_context FROM ctx")
def error_context(t):
    return A.error_context(A.error_streak(B.stored_agent_log(t))).select("session_id", "step", "error_context")


@query("stuck_points", AGENT + SUMMARY + "SELECT session_id, step, gap_s FROM stuck")
def stuck_points(t):
    return _stuck(t).select("session_id", "step", "gap_s")


@query("execution_trace", "WITH " + B.EVENTS_SQL + """
SELECT session_id, row_number() OVER w AS step, floor((us - first_value(us) OVER w) / 10000.0::DOUBLE + 0.5) / 100 AS relative_s, floor(value * 100 + 0.5) / 100 AS duration_s
FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id)""")
def execution_trace(t):
    spans = B.events(t).select("session_id", F.col("event_id").alias("order_key"), F.col("us").alias("started_us"),
                               (F.col("us") + centis(F.col("value")) * 10_000).alias("ended_us"))
    return A.execution_trace(spans).select("session_id", "step", "relative_s", "duration_s")


@query("timeline", AGENT + """
SELECT session_id, step, floor(relative_s / total * 100 + 0.5 / 1) IS NULL AS empty,
  floor(relative_s / total * 100.0::DOUBLE * 100 + 0.5) / 100 AS left_pct,
  greatest(floor(coalesce(nullif(duration_s, 0), 0.5) / total * 100.0::DOUBLE * 100 + 0.5) / 100, 0.8) AS width_pct
FROM agent JOIN (SELECT session_id, nullif(max(relative_s), 0) AS total FROM agent GROUP BY 1) USING (session_id)""")
def timeline(t):
    rows = B.stored_agent_log(t)
    totals = rows.groupBy("session_id").agg(F.max("relative_s").alias("total_duration_s"))
    return A.timeline(rows, totals).select("session_id", "step", F.col("left_pct").isNull().alias("empty"), "left_pct", "width_pct")


IMPRESSIONS = """,
placed AS (SELECT *, CASE WHEN page_url = '' THEN 'unknown' ELSE page_url END AS place FROM agent),
impressions AS (
  SELECT session_id, step, relative_s AS elapsed_s,
    CASE WHEN NOT success THEN 'Failed to ' || action_name || ' on ' || substr(target, 1, 50) || ': ' || substr(error, 1, 100)
         ELSE 'After ' || step || ' actions, currently at ' || place END AS context,
    CASE WHEN NOT success THEN 'frustration' ELSE 'neutral' END AS sentiment, place AS url
  FROM placed WHERE NOT success OR step % 5 = 0
  UNION ALL
  SELECT session_id, max(step), arg_max(relative_s, step), 'Session complete after ' || max(step) || ' steps, ' || """ + f0("arg_max(relative_s, step)") + """ || 's', 'summary', arg_max(place, step)
  FROM placed GROUP BY 1)"""


@query("impressions", AGENT + IMPRESSIONS + "SELECT * FROM impressions")
def impressions(t):
    return A.impressions(B.stored_agent_log(t))


@query("last_actions", AGENT + """SELECT session_id, step, action_name, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step DESC) AS rank FROM agent) WHERE rank <= 20""")
def last_actions(t):
    return A.last_k(B.agent_actions(t), ["session_id"], "step", 20).select("session_id", "step", "action_name", "rank")


@query("agent_log_line", AGENT + """SELECT session_id, step, '  [' || relative_s || 's] ' || action_name || ' - ' || CASE WHEN success THEN 'OK' ELSE 'FAILED' END
  || ' (' || duration_s || 's)' || CASE WHEN success THEN '' ELSE ' ERROR: ' || error END
  || CASE WHEN length('{"target":"' || target || '"}') < 100 THEN ' {"target":"' || target || '"}' ELSE '' END AS line FROM agent""")
def agent_log_line(t):
    details = F.to_json(F.struct("target"))
    return B.agent_actions(t).select("session_id", "step", A.agent_log_line(details).alias("line"))


@query("action_label", """
SELECT event_id, CASE event_type
  WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'Opened a post' ELSE 'Opened "post ' || k || '"' END
  WHEN 'signup' THEN CASE WHEN k % 7 = 0 THEN 'Comment skipped (probability)' WHEN k = 0 THEN 'Wrote comment (? chars)' ELSE 'Wrote comment (' || k || ' chars)' END
  WHEN 'purchase' THEN CASE WHEN k % 7 = 0 THEN 'Vote skipped (probability)' ELSE 'Voted on post' END
  WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'Scanned feed (quick)' ELSE 'Scanned feed (default)' END
  ELSE 'Browsed r/s' || (k % 4) END AS label
FROM (SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""")
def action_label(t):
    k = F.col("k")
    names = {"click": "open_post", "signup": "write_comment", "purchase": "vote_on_post", "view": "scan_feed", "error": "browse_subreddit"}
    name = F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("event_type")]
    details = F.to_json(F.struct(
        F.when(F.pmod(k, F.lit(3)) != 0, F.concat(F.lit("post "), k.cast("string"))).alias("post_title"),
        (F.pmod(k, F.lit(7)) == 0).alias("skipped"), k.alias("comment_length"),
        F.when(F.pmod(k, F.lit(2)) == 0, F.lit("quick")).alias("pattern"),
        F.concat(F.lit("s"), F.pmod(k, F.lit(4)).cast("string")).alias("subreddit")))
    return B.events(t).select("event_id", A.action_label(name, details).alias("label"))


FACTS = IMPRESSIONS + """,
h AS (
  SELECT session_id, count(*) AS n, count(*) FILTER (WHERE success) AS ok, max(relative_s) AS duration, count(*) FILTER (WHERE action = 'click') AS clicks,
    count(*) FILTER (WHERE action = 'scroll') AS scrolls, count(*) FILTER (WHERE action = 'type') AS types, count(DISTINCT action) AS kinds,
    count(DISTINCT nullif(target, '')) AS targets FROM agent GROUP BY 1),
i AS (
  SELECT session_id, count(DISTINCT CASE WHEN url NOT IN ('', 'unknown') THEN url END) AS pages, count(*) FILTER (WHERE sentiment IN ('frustration', 'confusion')) AS upset,
    count(*) FILTER (WHERE lower(context) LIKE '%stuck%') AS stuck, count(*) FILTER (WHERE sentiment = 'summary') AS summaries,
    count(*) FILTER (WHERE sentiment = 'frustration') AS frustrations, count(*) FILTER (WHERE sentiment = 'positive') AS positives FROM impressions GROUP BY 1),
facts AS (SELECT * FROM h JOIN i USING (session_id)),
scores AS (
  SELECT session_id, n AS total_actions, ok AS successful_actions, pages AS pages_discovered, targets AS unique_targets_interacted,
    floor(ok / n::DOUBLE * 1000 + 0.5) / 1000 AS success_rate, floor(pages / greatest(pages, 1)::DOUBLE * 1000 + 0.5) / 1000 AS coverage_score,
    floor(least(1.0, kinds / n::DOUBLE * 0.4::DOUBLE + (clicks + types) / n::DOUBLE * 0.4::DOUBLE + CASE WHEN n / greatest(duration, 1) * 60 > 2 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END) * 1000 + 0.5) / 1000 AS consistency_score,
    floor(n / greatest(duration, 1) * 60 * 100 + 0.5) / 100 AS actions_per_minute, floor(kinds / n::DOUBLE * 1000 + 0.5) / 1000 AS action_diversity_ratio,
    floor((clicks + types) / n::DOUBLE * 1000 + 0.5) / 1000 AS engagement_ratio, clicks AS click_count, scrolls AS scroll_count, types AS type_count,
    n - ok AS total_failures, floor((n - ok) / n::DOUBLE * 1000 + 0.5) / 1000 AS failure_rate, upset AS frustration_impressions, stuck AS stuck_events,
    floor((n - ok + upset) / n::DOUBLE * 1000 + 0.5) / 1000 AS friction_density,
    (CASE WHEN n >= 5 THEN 0.25 ELSE 0 END + CASE WHEN duration >= 30 THEN 0.25 ELSE 0 END + CASE WHEN kinds >= 3 THEN 0.25 ELSE 0 END
      + CASE WHEN ok / n::DOUBLE >= 0.5 THEN 0.25 ELSE 0 END)::DOUBLE AS completeness_score,
    floor(duration * 10 + 0.5) / 10 AS total_duration_s, kinds >= 3 AS has_varied_actions, summaries > 0 AS has_session_summary, frustrations, positives
  FROM facts)"""


def _facts(t):
    rows = B.stored_agent_log(t)
    return SC.session_facts(rows, A.impressions(rows))


@query("score_exploration", AGENT + FACTS + "SELECT session_id, pages_discovered, unique_targets_interacted, total_actions, successful_actions, success_rate, coverage_score FROM scores")
def score_exploration(t):
    return _facts(t).select("session_id", SC.score_exploration().alias("s")).select("session_id", "s.*")


@query("score_consistency", AGENT + FACTS + """SELECT session_id, consistency_score, actions_per_minute, action_diversity_ratio, engagement_ratio, click_count, scroll_count, type_count,
  'unknown' AS demographic_label FROM scores""")
def score_consistency(t):
    return _facts(t).select("session_id", SC.score_consistency().alias("s")).select("session_id", "s.*")


@query("score_friction", AGENT + FACTS + "SELECT session_id, total_failures, failure_rate, frustration_impressions, stuck_events, friction_density FROM scores")
def score_friction(t):
    return _facts(t).select("session_id", SC.score_friction().alias("s")).select("session_id", "s.*")


@query("score_completeness", AGENT + FACTS + """SELECT session_id, completeness_score, total_actions AS total_steps, total_duration_s, success_rate, has_varied_actions,
  has_session_summary FROM scores""")
def score_completeness(t):
    return _facts(t).select("session_id", SC.score_completeness().alias("s")).select("session_id", "s.*")


@query("run_all_scorers", AGENT + FACTS + """SELECT session_id, success_rate AS exploration_headline, consistency_score AS consistency_headline, failure_rate AS friction_headline,
  completeness_score AS completeness_headline, coverage_score, engagement_ratio, friction_density, has_varied_actions FROM scores""")
def run_all_scorers(t):
    return SC.run_all_scorers(_facts(t)).select(
        "session_id", "exploration_headline", "consistency_headline", "friction_headline", "completeness_headline", "exploration_coverage.coverage_score",
        "demographic_consistency.engagement_ratio", "friction_detection.friction_density", "session_completeness.has_varied_actions")


@query("agent_cards", AGENT + FACTS + "SELECT session_id, floor(successful_actions / total_actions::DOUBLE * 100 + 0.5)::BIGINT AS success_pct, frustrations, positives FROM scores")
def agent_cards(t):
    rows = B.stored_agent_log(t)
    return SC.agent_cards(rows, A.impressions(rows))


# The driver's gaps are hours, so its agent looks fast; slowdowns compare mean duration with a day's share of the gap.
FRICTION = TIMINGS + """,
slow AS (SELECT session_id, action_name, real_user_avg_s / 5000 AS real_user_avg_s, floor(agent_avg_s / (real_user_avg_s / 5000) * 100 + 0.5) / 100 AS slowdown FROM deltas),
grouped AS (
  SELECT session_id, action_name, count(*) AS occurrences, count(*) FILTER (WHERE NOT success) AS failures, count(*) FILTER (WHERE skipped) AS skipped FROM agent GROUP BY 1, 2),
items0 AS (
  SELECT g.*, t.agent_avg_s AS avg_duration_s, coalesce(s.slowdown, 0) AS slowdown, coalesce(s.real_user_avg_s, 0) AS real_user_avg_s,
    failures * 55 + CASE WHEN coalesce(slowdown, 0) >= 5 THEN 25 WHEN slowdown >= 3 THEN 15 WHEN slowdown >= 1.5 THEN 5 ELSE 0 END
      + CASE WHEN agent_avg_s > 6 THEN 10 ELSE 0 END + skipped * 5 AS score
  FROM grouped g JOIN timings t USING (session_id, action_name) LEFT JOIN slow s USING (session_id, action_name)),
items AS (
  SELECT *, score > 0 OR slowdown > 1 AS has_friction, CASE WHEN score >= 40 THEN 'critical' WHEN score >= 20 THEN 'high' WHEN score >= 10 THEN 'medium' ELSE 'low' END AS severity,
    concat_ws('; ', CASE WHEN failures > 0 THEN failures || ' failure(s) — agent could not complete this action' END,
      CASE WHEN failures > 0 THEN failures || ' error(s) encountered' END,
      CASE WHEN slowdown >= 1.5 THEN """ + f1("slowdown") + """ || 'x slower than real user' || CASE WHEN slowdown >= 5 THEN ' — significant UI friction' WHEN slowdown >= 3 THEN ' — moderate friction' ELSE '' END END,
      CASE WHEN avg_duration_s > 6 THEN 'High average duration (' || """ + f1("avg_duration_s") + """ || 's) — may indicate loading or rendering delays' END,
      CASE WHEN skipped > 0 THEN skipped || 'x skipped (probability) — agent uncertain about interaction' END) AS reasons
  FROM items0)"""


def _slow(t):
    real = F.col("real_user_avg_s") / 5000.0
    return _deltas(t).withColumn("ratio", F.floor(F.col("agent_avg_s") / real * 100.0 + 0.5) / F.lit(100.0)).withColumn("real_user_avg_s", real)


def _friction(t):
    return SC.friction_items(B.stored_agent_log(t), _slow(t))


@query("friction_items", BOTH + FRICTION + """SELECT session_id, action_name, occurrences, failures, skipped, avg_duration_s, slowdown, score::BIGINT AS score, reasons, severity
FROM items WHERE has_friction""")
def friction_items(t):
    return _friction(t).filter("has_friction").drop("has_friction").withColumn("reasons", F.array_join("reasons", "; "))


@query("heat_intensity", BOTH + FRICTION + """SELECT session_id, action_name, CASE WHEN peak > 0 THEN floor(CASE WHEN has_friction THEN score ELSE 0 END / peak::DOUBLE * 1000 + 0.5) / 1000 ELSE 0 END AS intensity
FROM (SELECT *, max(CASE WHEN has_friction THEN score ELSE 0 END) OVER (PARTITION BY session_id) AS peak FROM items)""")
def heat_intensity(t):
    return SC.heat_intensity(_friction(t)).select("session_id", "action_name", "intensity")


@query("slowdown_rank", BOTH + FRICTION + """SELECT session_id, replace(action_name, '_', ' ') AS label, slowdown,
  CASE WHEN slowdown > 0 THEN rank() OVER (PARTITION BY session_id ORDER BY slowdown DESC) END AS rank,
  CASE WHEN slowdown >= 5 THEN 'red' WHEN slowdown >= 3 THEN 'amber' WHEN slowdown >= 1.5 THEN 'yellow' WHEN slowdown > 0 THEN 'green' END AS tier,
  CASE WHEN slowdown > 0 THEN floor(least(slowdown / max(slowdown) OVER (PARTITION BY session_id) * 100, 100) * 100 + 0.5) / 100 END AS bar_pct
FROM items""")
def slowdown_rank(t):
    timings = A.avg_action_timings(B.stored_agent_log(t))
    return SC.slowdown_rank(timings, _slow(t)).select("session_id", "label", "slowdown", "rank", "tier", "bar_pct")


@query("overall_rollup", "WITH " + B.EVENTS_SQL + """
SELECT cluster_id, count(*) AS total_actions, count(*) FILTER (WHERE k % 5 <> 0) AS total_success, floor(count(*) FILTER (WHERE k % 5 <> 0) / count(*)::DOUBLE * 100 + 0.5) / 100 AS rate
FROM (SELECT session_id % 4 AS cluster_id, k FROM ev) GROUP BY ROLLUP (cluster_id)""")
def overall_rollup(t):
    runs = B.events(t).select(F.pmod("session_id", F.lit(4)).alias("cluster_id"), (F.pmod("k", F.lit(5)) != 0).alias("success"))
    return SC.overall_rollup(runs)


@query("hero_stats", AGENT + SUMMARY + COMPLETION + DEVIATION + """
SELECT session_id, successful_actions || '/' || executed_actions AS completed, floor(completion_rate * 100 + 0.5)::BIGINT AS completion_pct, floor(match_rate * 100 + 0.5)::BIGINT AS match_pct,
  CASE WHEN duration_ratio < 1 THEN 'Agent faster than user' ELSE 'Agent slower than user' END AS speed_text, CASE WHEN duration_ratio > 1.5 THEN 'amber' ELSE 'green' END AS speed_tone,
  CASE WHEN total_errors > 0 THEN 'red' ELSE 'green' END AS error_tone
FROM completion LEFT JOIN (SELECT session_id, match_rate FROM deviation) USING (session_id)""")
def hero_stats(t):
    return SC.hero_stats(_completion(t), A.positional_match(*B.agent_sequences(t)))


@query("demographics_counts", """
SELECT 'age_group' AS trait, c_mktsegment AS value, count(*) AS people FROM customer GROUP BY 2
UNION ALL SELECT 'country', coalesce(CASE WHEN c_nationkey % 9 <> 0 THEN 'n' || c_nationkey END, '?'), count(*) FROM customer GROUP BY 2""")
def demographics_counts(t):
    people = t.customer.select(F.col("c_mktsegment").alias("age_group"),
                               F.when(F.pmod("c_nationkey", F.lit(9)) != 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("country"))
    return SC.demographics_counts(people)
