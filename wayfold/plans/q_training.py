"""Queries over ordered actions: hesitation, windows, state texts, examples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions.exprs import rounded
from wayfold.operators import filters as FL
from wayfold.operators import training as TR
from wayfold.plans import bindings as B
from wayfold.plans.registry import query

WITH = "WITH " + B.ACTIONS_SQL
CONTEXT = TR.product_context("Shop", "https://shop.example", "lists and forms")

F1 = "(((floor({0} * 100 + 0.5)::BIGINT + 5) // 10) // 10) || '.' || (((floor({0} * 100 + 0.5)::BIGINT + 5) // 10) % 10)"


def f1(c: str) -> str:
    return F1.format(c)


def f0(c: str) -> str:
    return f"floor({c} + 0.5)::BIGINT"


WINDOWED = """,
lined AS (
  SELECT *, '  [' || """ + f1('"time"') + """ || 's] ' || action || CASE action
      WHEN 'CLICK' THEN ' on ' || target_tag || CASE WHEN target_text <> '' THEN ' "' || target_text || '"' WHEN target_href <> '' THEN ' "' || target_href || '"' ELSE '' END
      WHEN 'SCROLL' THEN ' ' || direction || ' to ' || scroll_to || 'px'
      WHEN 'TYPE' THEN ' ' || text_length || ' chars into ' || target_tag || CASE WHEN target_placeholder <> '' THEN ' ("' || target_placeholder || '")' ELSE '' END
      WHEN 'API_CALL' THEN ' ' || path WHEN 'PAGE_LOAD' THEN ' ' || url END AS line
  FROM actions),
windowed AS (
  SELECT *, lag("time") OVER w AS prev_time, coalesce(lag("time") OVER w, 0) AS elapsed,
    coalesce(string_agg(line, chr(10)) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS recent,
    last_value("time") OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS duration,
    count(*) OVER (PARTITION BY session_id) AS n_actions
  FROM lined WINDOW w AS (PARTITION BY session_id ORDER BY step)),
answered AS (
  SELECT *, CASE WHEN prev_time IS NULL THEN trunc("time" * 1000)::BIGINT ELSE greatest(0, trunc(("time" - prev_time) * 1000)::BIGINT) END AS hesitation_ms,
    'Product: Shop' || chr(10) || 'URL: https://shop.example' || chr(10) || 'Features: lists and forms' || chr(10) || chr(10)
      || 'Session: step ' || (step - 1) || ', elapsed ' || """ + f1("elapsed") + """ || 's / ' || """ + f0("duration") + """ || 's'
      || CASE WHEN recent <> '' THEN chr(10) || chr(10) || 'Recent actions:' || chr(10) || recent ELSE '' END
      || chr(10) || chr(10) || 'What would you do next?' AS state,
    CASE action WHEN 'CLICK' THEN 'click' WHEN 'SCROLL' THEN 'scroll' WHEN 'TYPE' THEN 'type' WHEN 'API_CALL' THEN 'wait'
      ELSE CASE WHEN url LIKE '%back%' THEN 'navigate_back' ELSE 'click' END END AS next_action,
    CASE action WHEN 'CLICK' THEN target_tag || ' "' || CASE WHEN target_text <> '' THEN target_text WHEN target_href <> '' THEN target_href ELSE target_class END || '"'
      WHEN 'SCROLL' THEN direction || ' to ' || scroll_to || 'px' WHEN 'TYPE' THEN target_tag || ' (' || target_placeholder || ')'
      WHEN 'API_CALL' THEN 'API response from ' || path ELSE url END AS next_target,
    CASE action WHEN 'CLICK' THEN 'Exploring ' || target_tag || ' element to interact with the product'
      WHEN 'SCROLL' THEN 'Scrolling ' || direction || ' to ' || CASE WHEN direction = 'down' THEN 'discover more content' ELSE 'review earlier content' END
      WHEN 'TYPE' THEN 'Entering text to engage with the application' WHEN 'API_CALL' THEN 'Waiting for the application to respond'
      ELSE 'Navigating to a new section of the product' END AS reasoning
  FROM windowed)"""


@query("actions_table", WITH + """SELECT session_id, step, "time", action, target_tag, target_text, target_href, target_class, scroll_from, scroll_to,
  max_depth, direction, text_length, is_masked, target_placeholder, path, full_path, url, viewport, x, y, duration_s FROM actions""")
def actions_table(t):
    return B.actions(t)


@query("hesitation_ms", WITH + WINDOWED + "SELECT session_id, step, hesitation_ms FROM answered")
def hesitation_ms(t):
    return TR.with_recent(B.actions(t), 1).select("session_id", "step", "hesitation_ms")


@query("recent_window", WITH + WINDOWED + "SELECT session_id, step, recent FROM answered")
def recent_window(t):
    return TR.with_recent(B.actions(t)).select("session_id", "step", F.array_join("recent", "\n").alias("recent"))


@query("elapsed", WITH + WINDOWED + "SELECT session_id, step, step - 1 AS idx, elapsed FROM answered")
def elapsed(t):
    return TR.with_recent(B.actions(t), 1).select("session_id", "step", (F.col("step") - 1).alias("idx"), "elapsed")


def _sessions(t):
    return B.stored_actions(t).groupBy("session_id").agg(
        F.max_by("time", "step").alias("session_duration_s"), F.count(F.lit(1)).alias("n_actions")
    ).withColumn("cluster_id", F.pmod("session_id", F.lit(5)))


@query("state_text", WITH + WINDOWED + "SELECT session_id, step, state FROM answered")
def state_text(t):
    rows = TR.with_recent(B.stored_actions(t)).join(_sessions(t).select("session_id", "session_duration_s"), "session_id")
    return rows.select("session_id", "step", TR.state_text(CONTEXT, F.col("session_duration_s")).alias("state"))


@query("next_action", WITH + WINDOWED + "SELECT session_id, step, next_action AS action, next_target AS target, reasoning FROM answered")
def next_action(t):
    answer = TR.next_action()
    return B.actions(t).select("session_id", "step", *[answer[c].alias(c) for c in ("action", "target", "reasoning")])


PERSONA = """
persona AS (
  SELECT r_regionkey AS cluster_id, 'Act as told.' || chr(10) || chr(10) || 'Your persona: "' || r_name || '"' || chr(10) || 'Visitors of ' || r_name
    || chr(10) || 'Key behaviors:' || chr(10) || '- ' || lower(r_name) || chr(10) || '- scrolls' || chr(10) || 'Avg session: 60s, 7 actions' AS system
  FROM region)"""


def _personas(t):
    clusters = t.region.select(
        F.col("r_regionkey").cast("long").alias("cluster_id"), F.col("r_name").alias("label"),
        F.concat(F.lit("Visitors of "), "r_name").alias("description"),
        F.array(F.lower("r_name"), F.lit("scrolls")).alias("key_behaviors"),
        F.lit(60.25).alias("avg_duration_s"), F.lit(6.75).alias("avg_actions"))
    return TR.persona_text(clusters, base="Act as told.")


@query("persona_text", "WITH " + PERSONA + "SELECT cluster_id::BIGINT AS cluster_id, system FROM persona")
def persona_text(t):
    return _personas(t)


EXAMPLES = WITH + WINDOWED + "," + PERSONA + """,
examples AS (
  SELECT cluster_id::BIGINT AS cluster_id, session_id, step, state AS "user", system,
    to_json(struct_pack(action := next_action, target := next_target, reasoning := reasoning, hesitation_ms := hesitation_ms))::VARCHAR AS assistant
  FROM answered JOIN persona ON persona.cluster_id = session_id % 5
  WHERE step > 1 AND action NOT IN ('API_CALL', 'PAGE_LOAD', 'FULL_SNAPSHOT', 'PAGE_META') AND n_actions >= 3)"""


def _examples(t):
    return TR.training_examples(B.stored_actions(t), _sessions(t), _personas(t), CONTEXT)


@query("training_examples", EXAMPLES + "SELECT * FROM examples")
def training_examples(t):
    return _examples(t)


DIALOGUE = """
WITH ex AS (SELECT conv_id % 5 AS cluster_id, conv_id, turn FROM conversations),
n AS (SELECT cluster_id, count(*) AS n, greatest(1, floor(count(*) * 0.1::DOUBLE)::BIGINT) AS v FROM ex GROUP BY 1),
c AS (SELECT cluster_id, 'val' AS split, v AS examples FROM n UNION ALL SELECT cluster_id, 'train', n - v FROM n WHERE n > v)"""


def _dialogue_split(t):
    rows = t.conversations.select(F.pmod("conv_id", F.lit(5)).alias("cluster_id"), "conv_id", "turn")
    return TR.sequence_split(rows, "cluster_id", ["conv_id", "turn"])


@query("sequence_split", DIALOGUE + "SELECT * FROM c")
def sequence_split(t):
    return _dialogue_split(t).groupBy("cluster_id", "split").agg(F.count(F.lit(1)).alias("examples"))


@query("training_counts", DIALOGUE + "SELECT cluster_id, split, sum(examples)::BIGINT AS examples FROM c GROUP BY ROLLUP (cluster_id, split)")
def training_counts(t):
    return TR.training_counts(_dialogue_split(t))


@query("session_overview", WITH + WINDOWED + """,
runs AS (
  SELECT session_id, run, count(*) AS scrolls FROM (
    SELECT session_id, action, sum(CASE WHEN action = 'SCROLL' THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY step) AS run FROM actions)
  WHERE action = 'SCROLL' GROUP BY 1, 2),
r AS (SELECT session_id, count(*) AS scroll_runs, max(scrolls) AS longest_run FROM runs GROUP BY 1)
SELECT a.session_id, count(*) AS n_actions, count(*) FILTER (WHERE action NOT IN ('API_CALL', 'PAGE_LOAD')) AS n_real_actions,
  max("time") AS duration_s, max(hesitation_ms) AS max_hesitation_ms, sum(hesitation_ms)::BIGINT AS total_hesitation_ms,
  coalesce(any_value(scroll_runs), 0) AS scroll_runs, coalesce(any_value(longest_run), 0) AS longest_run
FROM answered a LEFT JOIN r USING (session_id) GROUP BY 1""")
def session_overview(t):
    """Flagship: scan, ordered steps, scroll runs, hesitation and a per-session summary in one lineage."""
    is_scroll = F.col("event_type") == "view"
    kind = F.col("event_type")
    from wayfold.functions.exprs import div

    ms = div(F.col("us"), 1000)
    rows = (
        B.ordered(B.events(t))
        .first("_ms0", ms)
        .previous("_prev", ms)
        .running_sum("run", F.when(is_scroll, F.lit(0)).otherwise(F.lit(1)))
        .build()
        .withColumn("time", div(ms - F.col("_ms0") + 5, 10) / F.lit(100.0))
        .withColumn("_before", div(F.col("_prev") - F.col("_ms0") + 5, 10) / F.lit(100.0))
        .withColumn("hesitation_ms", TR.hesitation(F.col("time"), F.col("_before")))
    )
    per_run = rows.groupBy("session_id", "run").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_scroll).alias("scrolls"),
        F.count_if(~kind.isin("purchase", "error")).alias("real"), F.max("time").alias("time"),
        F.max("hesitation_ms").alias("hes_max"), F.sum("hesitation_ms").alias("hes_sum"))
    return per_run.groupBy("session_id").agg(
        F.sum("n").alias("n_actions"), F.sum("real").alias("n_real_actions"), F.max("time").alias("duration_s"),
        F.max("hes_max").alias("max_hesitation_ms"), F.sum("hes_sum").alias("total_hesitation_ms"),
        F.count_if(F.col("scrolls") > 0).alias("scroll_runs"), F.max("scrolls").alias("longest_run"))


@query("min_actions", WITH + "SELECT session_id, count(*) AS n_actions FROM actions GROUP BY 1 HAVING count(*) >= 60")
def min_actions(t):
    return FL.min_actions(B.action_kinds(t), 60)


@query("real_actions", WITH + """SELECT session_id, count(*) AS n_actions, count(*) FILTER (WHERE action NOT IN ('API_CALL', 'PAGE_LOAD')) AS n_real_actions
FROM actions GROUP BY 1 HAVING count(*) FILTER (WHERE action NOT IN ('API_CALL', 'PAGE_LOAD')) >= 40""")
def real_actions(t):
    return FL.real_actions(B.action_kinds(t), 40)


@query("corpus_stats", WITH + """SELECT count(*) AS sessions, sum(n)::BIGINT AS total_real_actions, floor(sum(n)::DOUBLE / count(*) * 100 + 0.5) / 100 AS avg_real_actions
FROM (SELECT session_id, count(*) FILTER (WHERE action NOT IN ('API_CALL', 'PAGE_LOAD')) AS n FROM actions GROUP BY 1) WHERE n >= 3""")
def corpus_stats(t):
    return FL.real_actions(B.action_kinds(t)).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("n_real_actions").alias("total_real_actions"),
        rounded(F.sum("n_real_actions") / F.count(F.lit(1))).alias("avg_real_actions"))
