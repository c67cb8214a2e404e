"""Queries over texts, answers, payloads, pages, reports and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import html as H
from wayfold.functions import text as TX
from wayfold.operators import agent as A
from wayfold.operators import clusters as C
from wayfold.operators import reports as R
from wayfold.plans import bindings as B
from wayfold.plans import q_agent as QA
from wayfold.plans.q_training import f0
from wayfold.plans.registry import query

ACTIONS = "WITH " + B.ACTIONS_SQL
LOG = """,
lines AS (SELECT session_id, step, '[' || "time" || 's] ' || CASE action
    WHEN 'CLICK' THEN 'Clicked ' || target_tag || CASE WHEN target_href <> '' THEN ' (link to: ' || target_href || ')' ELSE '' END
      || CASE WHEN target_text <> '' THEN ' text="' || target_text || '"' ELSE '' END || ' at (' || x::BIGINT || ', ' || y::BIGINT || ')'
    WHEN 'SCROLL' THEN 'Scrolled ' || direction || ' from ' || scroll_from || 'px to ' || scroll_to || 'px (max depth: ' || max_depth || 'px) over ' || duration_s || 's'
    WHEN 'TYPE' THEN 'Typed ' || text_length || ' characters into ' || target_tag || CASE WHEN target_placeholder <> '' THEN ' (placeholder: "' || target_placeholder || '")' ELSE '' END
    WHEN 'API_CALL' THEN 'API: ' || full_path ELSE 'Page loaded: ' || url || ' (' || viewport || ')' END AS line FROM actions),
logs AS (SELECT session_id, (step - 1) // 10000 AS page, string_agg(line, chr(10) ORDER BY step) AS log FROM lines GROUP BY 1, 2)"""


@query("action_log_line", ACTIONS + LOG + "SELECT session_id, step, line FROM lines")
def action_log_line(t):
    return B.actions(t).select("session_id", "step", TX.action_log_line().alias("line"))


@query("action_log", ACTIONS + LOG + "SELECT * FROM logs")
def action_log(t):
    return R.action_log(B.actions(t))


K_SQL = "json_extract_string(props, '$.k')::BIGINT"


def _k():
    return F.get_json_object("props", "$.k").cast("long")


def _mod(m):
    return F.pmod(_k(), F.lit(m))


@query("parse_action_json", f"""
SELECT event_id, CASE k % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'type' WHEN 2 THEN 'scroll' ELSE 'scroll' END AS action,
  CASE k % 4 WHEN 0 THEN 'item ' || k WHEN 1 THEN 'box ' || k ELSE 'down 300px' END AS target, CASE k % 4 WHEN 0 THEN k WHEN 1 THEN NULL ELSE 500 END AS hesitation_ms
FROM (SELECT event_id, {K_SQL} AS k FROM events)""")
def parse_action_json(t):
    ks = _k().cast("string")
    answer = (
        F.when(_mod(4) == 0, F.concat(F.lit('{"action": "click", "target": "item '), ks, F.lit('", "hesitation_ms": '), ks, F.lit("}")))
        .when(_mod(4) == 1, F.concat(F.lit('Sure: {"action": "type", "target": "box '), ks, F.lit('"} as {asked}')))
        .when(_mod(4) == 2, F.lit("I would rather not say"))
        .otherwise(F.lit('{"action": {"broken": 1, "target": "x"'))
    )
    got = TX.parse_action_json(answer)
    return t.events.select("event_id", got["action"].alias("action"), got["target"].alias("target"), got["hesitation_ms"].alias("hesitation_ms"))


@query("parse_scroll_target", f"""
SELECT event_id, CASE WHEN k % 3 = 0 THEN -least(k * 50, 2000) WHEN k % 3 = 1 THEN least(k * 50, 2000) ELSE 300 END AS delta,
  CASE WHEN k % 3 = 0 THEN -k * 50 WHEN k % 3 = 1 THEN 400 ELSE 400 END AS explore_delta FROM (SELECT event_id, {K_SQL} AS k FROM events)""")
def parse_scroll_target(t):
    far = (_k() * 50).cast("string")
    target = F.when(_mod(3) == 0, F.concat(F.lit("Up "), far, F.lit("px"))).when(_mod(3) == 1, F.concat(F.lit("scroll down by "), far)).otherwise(F.lit("down a little"))
    return t.events.select("event_id", TX.parse_scroll_target(target).alias("delta"), TX.parse_explore_scroll(target).alias("explore_delta"))


@query("split_type_target", r"""
SELECT doc_id, length(f) AS field_length, length(x) AS text_length FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || ' box' ELSE source END AS f,
  CASE WHEN doc_id % 2 = 0 THEN regexp_replace('to: ' || "text", '^\s+|\s+$', '', 'g') END AS x FROM documents)""")
def split_type_target(t):
    target = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit(' "'), "source", F.lit(' box" : to: '), "text")).otherwise(F.concat(F.lit("'"), "source", F.lit("'")))
    got = TX.split_type_target(target)
    return t.documents.select("doc_id", F.length(got["field"]).cast("long").alias("field_length"), F.length(got["text"]).cast("long").alias("text_length"))


ID_SQL = f"""ids AS (SELECT event_id, CASE k % 6 WHEN 0 THEN 'rec' || k WHEN 1 THEN 'ses' || k WHEN 2 THEN 'plain' || k WHEN 3 THEN 'data' || k WHEN 4 THEN NULL ELSE 'data' || k END AS recording_id
  FROM (SELECT event_id, {K_SQL} AS k FROM events))"""


def webhook_bodies(t):
    ks = _k().cast("string")
    m = _mod(6)
    properties = F.struct(
        F.when(m == 0, F.concat(F.lit("rec"), ks)).when(m == 5, F.lit("")).alias("$session_recording_id"),
        F.when(m <= 1, F.concat(F.lit("ses"), ks)).alias("$session_id"), F.when(m == 2, F.concat(F.lit("plain"), ks)).alias("session_id"))
    data = F.struct(F.when(m.isin(3, 5), F.concat(F.lit("data"), ks)).alias("session_id"))
    return t.events.select("event_id", F.to_json(F.struct(F.lit("$pageview").alias("event"), properties.alias("properties"), data.alias("data"))).alias("body"))


@query("extract_id", "WITH " + ID_SQL + " SELECT * FROM ids")
def extract_id(t):
    return webhook_bodies(t).select("event_id", TX.extract_id(F.col("body")).alias("recording_id"))


CLEAN = r"""clean AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS v FROM pages)"""


def inner(e: str) -> str:
    out = f"regexp_replace({e}, '<[^>]*>', '', 'g')"
    for entity, char in H.ENTITIES.items():
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"replace(regexp_replace({out}, '^\\s+|\\s+$', '', 'g'), chr(10), ' ')"


OBSERVED = CLEAN + r""",
seen AS (SELECT page_id, url, """ + inner(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1)") + r""" AS title,
  list_transform(regexp_extract_all(v, '(?is)<a\b[^>]*>.*?</a\s*>')[1:20], lambda e: struct_pack(t := substr(""" + inner("e") + r""", 1, 50), h := substr(regexp_extract(e, '(?is)\shref\s*=\s*["'']([^"'']*)["'']', 1), 1, 60))) AS links,
  list_filter(list_transform(regexp_extract_all(v, '(?is)<(?:h1|h2|h3)\b[^>]*>.*?</(?:h1|h2|h3)\s*>')[1:8], lambda e: '[' || lower(substr(e, 2, 2)) || '] ' || substr(""" + inner("e") + r""", 1, 60)), lambda x: length(x) > 5) AS heads,
  list_transform(regexp_extract_all(v, '(?is)<(?:p|li)\b[^>]*>.*?</(?:p|li)\s*>')[1:10], lambda e: substr(""" + inner("e") + r""", 1, 80)) AS raw FROM clean),
parts AS (SELECT *, list_filter(links, lambda c, i: c.t <> '' AND list_position(list_transform(links, lambda z: lower(z.t)), lower(c.t)) = i) AS clicks,
  list_filter(raw, lambda x, i: length(x) > 5 AND list_position(raw, x) = i)[1:8] AS texts FROM seen)"""


@query("page_observation", "WITH " + OBSERVED + """
SELECT page_id, title, len(clicks) AS n_clickable, len(heads) AS n_headings, len(texts) AS n_texts, 0::BIGINT AS forms,
  'URL: ' || url || chr(10) || 'Title: ' || title || chr(10)
  || CASE WHEN len(clicks) > 0 THEN chr(10) || 'Clickable elements (use exact text in quotes for click target):' || chr(10)
     || array_to_string(list_transform(clicks, lambda c: '  - [link] "' || c.t || '"' || CASE WHEN c.h <> '' THEN ' → ' || c.h ELSE '' END), chr(10)) ELSE '' END
  || CASE WHEN len(heads) > 0 THEN chr(10) || 'Headings:' || chr(10) || array_to_string(list_transform(heads, lambda h: '  - ' || h), chr(10)) ELSE '' END
  || CASE WHEN len(texts) > 0 THEN chr(10) || 'Page content:' || chr(10) || array_to_string(list_transform(texts, lambda x: '  - ' || x), chr(10)) ELSE '' END AS observation
FROM parts""")
def page_observation(t):
    seen = H.page_observation(t.pages)
    return seen.select("page_id", "title", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("clickable", "headings", "texts")], "forms", "observation")


@query("compact_observation", "WITH " + OBSERVED + """
SELECT page_id, 'Page: ' || url || ' — ' || title
  || CASE WHEN len(links) > 0 THEN chr(10) || 'Nav: ' || array_to_string(list_transform(links[1:5], lambda c: substr(c.t, 1, 30)), ', ') ELSE '' END
  || CASE WHEN len(heads) > 0 THEN chr(10) || 'Content: ' || array_to_string(list_transform(heads[1:3], lambda h: substr(h, 6, 40)), ', ') ELSE '' END AS observation
FROM parts""")
def compact_observation(t):
    return H.compact_observation(t.pages).select("page_id", "observation")


@query("dedupe_labels", r"""
WITH w AS (SELECT page_id, string_split(regexp_replace(lower(url), '[^a-z]+', ' ', 'g') || ' HTTP Example', ' ') AS words FROM pages)
SELECT page_id, array_to_string(list_filter(words, lambda x, i: list_position(list_transform(words, lambda z: lower(z)), lower(x)) = i), '|') AS labels FROM w""")
def dedupe_labels(t):
    words = F.split(F.concat(F.regexp_replace(F.lower("url"), "[^a-z]+", " "), F.lit(" HTTP Example")), " ")
    return t.pages.select("page_id", words.alias("w")).select("page_id", F.array_join(H.dedupe_labels(F.col("w")), "|").alias("labels"))


@query("classify_log_line", r"""
SELECT event_id, CASE k % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'error' WHEN 2 THEN 'warning' WHEN 3 THEN 'progress' WHEN 4 THEN 'progress' WHEN 5 THEN 'section' ELSE 'log' END AS kind
FROM (SELECT event_id, """ + K_SQL + " AS k FROM events)")
def classify_log_line(t):
    line = None
    for i, text in enumerate(["ERROR: no key", "ValueError: WARNING: bad", "  Warning: slow", " 3/10 done", "working...", "=== STEP ===", "saved file"]):
        value = F.concat(F.lit(text), F.lit(" "), "event_type")
        line = F.when(_mod(7) == i, value) if line is None else line.when(_mod(7) == i, value)
    return t.events.select("event_id", TX.classify_log_line(line).alias("kind"))


def _trimmed(e):
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


@query("markdown_sections", f"""
SELECT doc_id, length({_trimmed('"text"')}) AS friction, CASE WHEN doc_id % 2 = 0 THEN lang END AS accessibility, NULL::VARCHAR AS flow, 'none in ' || source AS performance,
  '- fix ' || lang AS recommendations, CASE WHEN doc_id % 3 = 0 THEN 'act on ' || source END AS takeaway FROM documents""")
def markdown_sections(t):
    report = F.concat(
        F.lit("# Report\n\n### 1. FRICTION POINTS\n"), "text",
        F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit("\n\n## **2. Accessibility Issues**\n"), "lang")).otherwise(F.lit("\n\n### 2.\n")),
        F.lit("\n\n### 3. Left out\n"),
        F.lit("\n\n### 4. Performance  Concerns\nnone in "), "source",
        F.lit("\n### **5. Specific Recommendations (ranked)**\n- fix "), "lang",
        F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("\n\n### Key Takeaway\n act on "), "source")).otherwise(F.lit("")))
    parts = TX.markdown_sections(F.col("report"))
    found = t.documents.select("doc_id", report.alias("report")).select("doc_id", *[
        parts[title].alias(name) for title, name in zip([*TX.SECTIONS, TX.TAKEAWAY], ["friction", "accessibility", "flow", "performance", "recommendations", "takeaway"])])
    return found.withColumn("friction", F.length("friction").cast("long"))


REPORT = "WITH " + B.ACTIONS_SQL + "," + B.AGENT_SQL[len(B.EVENTS_SQL) + 1:] + QA.SUMMARY + QA.TIMINGS + QA.COMPLETION + QA.DEVIATION
FAULTS = """,
first_errors AS (SELECT session_id, action_name, string_agg(error, ', ' ORDER BY step) AS first_errors
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id, action_name ORDER BY step) AS rn FROM agent WHERE NOT success) WHERE rn <= 3 GROUP BY 1, 2)"""
METRICS = """'### Completion' || nl || '| Metric | Value |' || nl || '|---|---|' || nl || '| Planned actions | ' || planned_actions || ' |' || nl || '| Executed | ' || executed_actions || ' |' || nl
  || '| Successful | ' || successful_actions || ' |' || nl || '| Failed | ' || failed_actions || ' |' || nl || '| Completion rate | ' || completion_rate || ' |'"""


@query("markdown_report", REPORT + FAULTS + """,
tm AS (SELECT session_id, string_agg('| ' || action_name || ' | ' || agent_avg_s || 's | ' || real_user_avg_s || 's | ' || delta_s || 's | ' || ratio || 'x |', chr(10) ORDER BY action_name) AS t FROM deltas GROUP BY 1),
er AS (SELECT session_id, string_agg('- **' || action_name || '**: ' || first_errors, chr(10) ORDER BY action_name) AS e FROM first_errors GROUP BY 1),
st AS (SELECT session_id, string_agg('- ' || action_name || ' at ' || relative_s || 's: ' || CASE WHEN step % 2 = 0 THEN 'late ' || action_name ELSE 'Timeout' END, chr(10) ORDER BY step) AS s FROM stuck GROUP BY 1),
kinds AS (SELECT DISTINCT session_id, action, 'did' AS side FROM actual UNION SELECT DISTINCT session_id, action, 'want' FROM planned),
df AS (SELECT session_id, string_agg(action, ', ' ORDER BY action) FILTER (WHERE side = 'want') AS missing, string_agg(action, ', ' ORDER BY action) FILTER (WHERE side = 'did') AS extra
  FROM (SELECT session_id, action, min(side) AS side FROM kinds GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1)
SELECT session_id, 0::BIGINT AS page, '# Session feedback report' || nl || '**Session:** ' || session_id || nl || '**Generated:** ' || coalesce(CASE WHEN c_nationkey > 3 THEN '2024-01-02' END, 'unknown') || nl || nl || '---' || nl || nl || '## Quantitative Metrics' || nl || nl || """ + METRICS + """ || nl || nl
  || '### Timing' || nl || '| Metric | Value |' || nl || '|---|---|' || nl || '| Agent duration | ' || agent_duration_s || 's |' || nl || '| Real user duration | ' || coalesce(real_user_duration_s::VARCHAR, 'N/A')
  || 's |' || nl || '| Duration ratio | ' || duration_ratio || 'x |' || nl || nl
  || coalesce('### Per-Action Timing Comparison' || nl || '| Action | Agent Avg | Real User Avg | Delta | Ratio |' || nl || '|---|---|---|---|---|' || nl || t || nl || nl, '')
  || '### Errors & Stuck Events' || nl || '- **Total errors:** ' || total_errors || nl || '- **Stuck events:** ' || total_stuck_events || nl || nl
  || coalesce('**Errors by action:**' || nl || e || nl || nl, '') || coalesce('**Stuck events:**' || nl || s || nl || nl, '')
  || '### Policy Deviation' || nl || '- **Match rate:** ' || coalesce(match_rate::VARCHAR, 'N/A') || nl || '- **Deviation score:** ' || deviation_score
  || coalesce(nl || '- **Missing actions:** ' || missing, '') || coalesce(nl || '- **Extra actions:** ' || extra, '')
  || coalesce(nl || nl || '---' || nl || nl || '## Qualitative Feedback' || nl || nl || 'Seen by ' || c_name, '') AS markdown
FROM (SELECT *, chr(10) AS nl FROM completion) LEFT JOIN tm USING (session_id) LEFT JOIN er USING (session_id) LEFT JOIN st USING (session_id)
LEFT JOIN (SELECT session_id, match_rate, deviation_score FROM deviation) USING (session_id) LEFT JOIN df USING (session_id) LEFT JOIN customer ON c_custkey = session_id""")
def markdown_report(t):
    sequences = B.agent_sequences(t)
    stuck = QA._stuck(t).withColumn("reason", F.when(F.col("step") % 2 == 0, F.concat(F.lit("late "), "action_name")))
    feedback = t.customer.select(F.col("c_custkey").alias("session_id"), F.when(F.col("c_nationkey") > 3, F.lit("2024-01-02")).alias("generated_at"), F.concat(F.lit("Seen by "), "c_name").alias("feedback"))
    return R.markdown_report(QA._completion(t), QA._deltas(t), A.top_errors(B.stored_agent_log(t)), stuck, A.positional_match(*sequences), A.sequence_differences(*sequences), feedback)


@query("report_json", REPORT + FAULTS + """,
kinds AS (SELECT DISTINCT session_id, action, 'did' AS side FROM actual UNION SELECT DISTINCT session_id, action, 'want' FROM planned),
df AS (SELECT session_id, count(*) FILTER (WHERE side = 'want') AS missing, count(*) FILTER (WHERE side = 'did') AS extra
  FROM (SELECT session_id, action, min(side) AS side FROM kinds GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1)
SELECT session_id, completion_rate, duration_ratio, total_errors, match_rate, n AS compared_actions, coalesce(missing, 0) AS missing_kinds, coalesce(extra, 0) AS extra_kinds,
  coalesce(e, 0) AS failing_kinds, s AS stuck_details, first_stuck, coalesce(clicks, 0) AS real_user_click_events FROM completion
LEFT JOIN (SELECT session_id, match_rate FROM deviation) USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM deltas GROUP BY 1) USING (session_id) LEFT JOIN df USING (session_id)
LEFT JOIN (SELECT session_id, count(*) AS e FROM first_errors GROUP BY 1) USING (session_id)
LEFT JOIN (SELECT session_id, count(*) AS s, arg_min(relative_s, step) AS first_stuck FROM stuck GROUP BY 1) USING (session_id)
LEFT JOIN (SELECT session_id, count(*) FILTER (WHERE action = 'CLICK') AS clicks FROM actions GROUP BY 1) USING (session_id)""")
def report_json(t):
    """The JSON document is written and read back; its fields must survive."""
    sequences = B.agent_sequences(t)
    docs = R.report_json(QA._completion(t), QA._deltas(t), A.top_errors(B.stored_agent_log(t)), QA._stuck(t), A.positional_match(*sequences), A.sequence_differences(*sequences),
                         A.engagement_counts(B.action_kinds(t), B.stored_agent_log(t)))

    def at(path, kind):
        return F.get_json_object("report", path).cast(kind)

    return docs.select("session_id", at("$.completion.completion_rate", "double").alias("completion_rate"), at("$.timing.duration_ratio", "double").alias("duration_ratio"),
                       at("$.errors.total_errors", "long").alias("total_errors"), at("$.deviation.match_rate", "double").alias("match_rate"),
                       *[F.json_array_length(F.get_json_object("report", path)).cast("long").alias(name) for path, name in (
                           ("$.timing.per_action_deltas", "compared_actions"), ("$.deviation.missing_action_types", "missing_kinds"),
                           ("$.deviation.extra_action_types", "extra_kinds"), ("$.errors.stuck_details", "stuck_details"))],
                       F.coalesce(F.json_array_length(F.get_json_object("report", "$.errors.errors_by_action")), F.lit(0)).cast("long").alias("failing_kinds"),
                       at("$.errors.stuck_details[0].relative_s", "double").alias("first_stuck"), at("$.engagement.real_user_click_events", "long").alias("real_user_click_events"))


def _with_length(df, *keys):
    return df.select(*keys, F.length("prompt").cast("long").alias("chars"), F.md5("prompt").alias("digest"))


@query("describe_prompt", ACTIONS + LOG + """,
d AS (SELECT session_id, max("time") AS d FROM actions GROUP BY 1),
p AS (SELECT session_id, page, 'Task.' || nl || nl || 'USER PROFILE:' || nl || '- Age group: ' || coalesce(c_mktsegment, 'unknown') || nl || '- Country: ' || coalesce('n' || c_nationkey, 'unknown') || nl
  || '- Device: unknown, unknown on unknown' || nl || nl || 'SESSION DURATION: ' || d || ' seconds' || nl || nl || 'ACTION LOG:' || nl || log AS prompt
  FROM (SELECT *, chr(10) AS nl FROM logs) LEFT JOIN customer ON c_custkey = session_id LEFT JOIN d USING (session_id))
SELECT session_id, page, length(prompt) AS chars, md5(prompt) AS digest FROM p""")
def describe_prompt(t):
    missing = F.lit(None).cast("string")
    profiles = t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("age_group"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("country"),
                                 missing.alias("device_type"), missing.alias("browser"), missing.alias("os"))
    actions = B.stored_actions(t)
    durations = actions.groupBy("session_id").agg(F.max("time").alias("session_duration_s"))
    return _with_length(R.describe_prompt(R.action_log(actions), profiles, durations, task="Task."), "session_id", "page")


@query("policy_prompt", """
WITH p AS (SELECT doc_id AS session_id, 'Task.' || chr(10) || chr(10) || 'USER PROFILE:' || chr(10) || CASE WHEN quality IS NULL THEN '{}' ELSE '{"quality":' || quality || ',"toxic":' || toxic || '}' END
  || chr(10) || chr(10) || 'OBSERVED BEHAVIOUR:' || chr(10) || "text" AS prompt FROM documents LEFT JOIN labels USING (doc_id))
SELECT session_id, length(prompt) AS chars, md5(prompt) AS digest FROM p""")
def policy_prompt(t):
    texts = t.documents.select(F.col("doc_id").alias("session_id"), "text")
    return _with_length(R.policy_prompt(texts, t.labels.withColumnRenamed("doc_id", "session_id"), task="Task."), "session_id")


@query("label_prompt", """
WITH s AS (SELECT source, count(*) AS size, floor(sum(floor(n_chars / 10.0::DOUBLE * 100 + 0.5)::BIGINT) / 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS avg_d, floor(sum(n_chars % 50) / count(*)::DOUBLE * 10 + 0.5) / 10 AS avg_a FROM documents GROUP BY 1),
e AS (SELECT source, string_agg('--- User ' || rank || ' ---' || chr(10) || substr("text", 1, 500), chr(10) ORDER BY rank) AS e
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 3 GROUP BY 1),
l AS (SELECT source, string_agg(lang || ': ' || n, ', ' ORDER BY lang) AS langs, arg_min(lang, (-n, lang)) AS top_lang FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang <> '' GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT source, string_agg(v || ': ' || n, ', ' ORDER BY v) AS cs, arg_min(v, (-n, v)) AS top_c FROM (SELECT source, 'c' || (doc_id % 5) AS v, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT source, 'Task.' || chr(10) || chr(10) || 'CLUSTER STATS:' || chr(10) || '- Users: ' || size || chr(10) || '- Dominant age group: ' || coalesce(top_lang, 'unknown') || chr(10) || '- Dominant country: ' || top_c || chr(10) || '- NYC familiarity: unknown' || chr(10)
  || '- Average session duration: ' || avg_d || 's' || chr(10) || '- Average actions per session: ' || avg_a || chr(10)
  || '- Age distribution: {' || coalesce(langs, '') || '}' || chr(10) || '- Country distribution: {' || cs || '}' || chr(10) || chr(10) || 'SAMPLE DESCRIPTIONS:' || chr(10) || e AS prompt FROM s JOIN e USING (source) LEFT JOIN l USING (source) LEFT JOIN c USING (source))
SELECT source, length(prompt) AS chars, md5(prompt) AS digest FROM p""")
def label_prompt(t):
    missing = F.lit(None).cast("string")
    members = t.documents.select("source", (F.col("n_chars") / 10.0).alias("duration_s"), F.pmod("n_chars", F.lit(50)).alias("n_actions"),
                                 F.col("lang").alias("age_group"), F.concat(F.lit("c"), F.pmod("doc_id", F.lit(5)).cast("string")).alias("country"), missing.alias("nyc_familiarity"))
    excerpts = C.cluster_excerpts(t.documents, "source", "doc_id", "text")
    return _with_length(R.label_prompt(C.cluster_profile(members, "source"), excerpts, "source", task="Task."), "source")


AGENT = "WITH " + B.AGENT_SQL


@query("narrative_prompt", AGENT + QA.SUMMARY + QA.IMPRESSIONS + """,
a AS (SELECT session_id, string_agg('  [' || relative_s || 's] ' || action_name || ' on ' || substr(target, 1, 40) || ' - ' || CASE WHEN success THEN 'OK' ELSE 'FAILED: ' || substr(error, 1, 50) END, chr(10) ORDER BY step) AS a
  FROM agent WHERE step <= 20 GROUP BY 1),
i AS (SELECT session_id, (step - 1) // 10000 AS page, string_agg('  [' || elapsed_s || 's] (' || sentiment || ') ' || substr(context, 1, 80), chr(10) ORDER BY step, sentiment = 'summary') AS i FROM impressions GROUP BY 1, 2),
p AS (SELECT session_id, page, 'Task.' || nl || nl || 'DEMOGRAPHIC PROFILE:' || nl || '- Age group: ' || coalesce(c_mktsegment, 'unknown') || nl || '- Country: ' || coalesce('n' || c_nationkey, 'unknown') || nl
  || '- NYC familiarity: unknown' || nl || '- Behavioral style: ' || coalesce(c_name, '') || nl || nl || 'SESSION SUMMARY:' || nl || '- Target app: shop' || nl || '- Duration: ' || """ + f0("total_duration_s") + """ || 's' || nl
  || '- Steps taken: ' || total_actions || nl || '- Successful: ' || successful_actions || nl || '- Failed: ' || failed_actions || nl || nl
  || 'ACTION LOG:' || nl || a || nl || nl || 'IMPRESSIONS:' || nl || i AS prompt
  FROM (SELECT *, chr(10) AS nl FROM i) LEFT JOIN a USING (session_id) LEFT JOIN summary USING (session_id) LEFT JOIN customer ON c_custkey = session_id)
SELECT session_id, page, length(prompt) AS chars, md5(prompt) AS digest FROM p""")
def narrative_prompt(t):
    rows = B.stored_agent_log(t)
    profiles = t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("age_group"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("country"),
                                 F.lit(None).cast("string").alias("nyc_familiarity"), F.col("c_name").alias("description"))
    return _with_length(R.narrative_prompt(rows, A.impressions(rows), profiles, QA._summary(t), target="shop", task="Task."), "session_id", "page")


@query("comparative_prompt", AGENT + QA.SUMMARY + QA.IMPRESSIONS + """,
f AS (SELECT session_id, string_agg('  [' || sentiment || '] ' || substr(context, 1, 80), chr(10) ORDER BY rn) AS f
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step, sentiment) AS rn FROM impressions) WHERE rn <= 5 GROUP BY 1),
fn AS (SELECT session_id, count(*) AS n FROM impressions GROUP BY 1),
s AS (SELECT session_id, '--- Agent ' || session_id || coalesce(': ' || c_mktsegment, '') || ' ---' || chr(10) || 'Steps: ' || total_actions || ', Duration: ' || """ + f0("total_duration_s") + """ || 's' || chr(10)
  || 'Successful: ' || successful_actions || ', Failed: ' || failed_actions || chr(10) || 'Impressions: ' || n || chr(10) || 'Narrative: ' || coalesce(substr("text", 1, 800), '') || chr(10) || f AS s
  FROM summary LEFT JOIN documents ON doc_id = session_id LEFT JOIN f USING (session_id) LEFT JOIN fn USING (session_id) LEFT JOIN customer ON c_custkey = session_id),
p AS (SELECT session_id // 3 AS run_id, 'Task.' || chr(10) || chr(10) || string_agg(s, chr(10) || chr(10) ORDER BY session_id) AS prompt FROM s GROUP BY 1)
SELECT run_id, length(prompt) AS chars, md5(prompt) AS digest FROM p""")
def comparative_prompt(t):
    """Three agents a run."""
    rows = B.stored_agent_log(t)
    narratives = t.documents.select(F.col("doc_id").alias("session_id"), F.col("text").alias("narrative"))
    labels = t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("label"))
    summary = QA._summary(t)
    sections = R.agent_sections(summary, narratives, A.impressions(rows), labels)
    runs = summary.select("session_id", F.floor(F.col("session_id") / 3).cast("long").alias("run_id"))
    return _with_length(R.comparative_prompt(sections, runs, task="Task."), "run_id")


@query("feedback_prompt", REPORT + FAULTS + """,
tm AS (SELECT session_id, string_agg('  - ' || action_name || ': agent ' || agent_avg_s || 's vs real user ' || real_user_avg_s || 's (ratio: ' || ratio || 'x)', chr(10) ORDER BY action_name) AS t FROM deltas GROUP BY 1),
er AS (SELECT session_id, string_agg('  - ' || action_name || ': ' || first_errors, chr(10) ORDER BY action_name) AS e FROM first_errors GROUP BY 1),
la AS (SELECT session_id, string_agg('  [' || relative_s || 's] ' || action_name || ' - ' || CASE WHEN success THEN 'OK' ELSE 'FAILED' END || ' (' || duration_s || 's)' || CASE WHEN success THEN '' ELSE ' ERROR: ' || error END, chr(10) ORDER BY step) AS l
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step DESC) AS rn FROM agent) WHERE rn <= 20 GROUP BY 1),
st AS (SELECT session_id, string_agg('  - Stuck at ' || action_name || ' (Timeout) on ' || coalesce(nullif(page_url, ''), '?'), chr(10) ORDER BY step) AS s FROM stuck GROUP BY 1),
p AS (SELECT session_id, 'Task.' || nl || nl || 'PROFILE:' || nl || coalesce(substr("text", 1, 2000), '') || nl || nl || """ + METRICS + """ || nl || nl || 'TIMING:' || nl || '  - Agent session duration: ' || agent_duration_s || 's' || nl
  || '  - Real user session duration: ' || coalesce(real_user_duration_s::VARCHAR, 'N/A') || 's' || nl || '  - Duration ratio: ' || duration_ratio || 'x' || coalesce(nl || t, '') || nl || nl
  || 'ERRORS:' || nl || '  - Total errors: ' || total_errors || nl || '  - Stuck events: ' || total_stuck_events || coalesce(nl || e, '') || nl || nl || 'STUCK EVENTS:' || nl || coalesce(s, '  None') || nl || nl
  || 'POLICY DEVIATION:' || nl || '  - Match rate: ' || coalesce(match_rate::VARCHAR, 'N/A') || nl || '  - Deviation score: ' || deviation_score || nl || nl || 'LAST ACTIONS:' || nl || l AS prompt
  FROM (SELECT *, chr(10) AS nl FROM completion) LEFT JOIN tm USING (session_id) LEFT JOIN er USING (session_id) LEFT JOIN la USING (session_id) LEFT JOIN st USING (session_id)
  LEFT JOIN (SELECT session_id, match_rate, deviation_score FROM deviation) USING (session_id) LEFT JOIN documents ON doc_id = session_id)
SELECT session_id, length(prompt) AS chars, md5(prompt) AS digest FROM p""")
def feedback_prompt(t):
    rows = B.stored_agent_log(t)
    texts = t.documents.select(F.col("doc_id").alias("session_id"), "text")
    deviation = A.positional_match(*B.agent_sequences(t))
    return _with_length(R.feedback_prompt(QA._completion(t), A.top_errors(rows), QA._deltas(t), rows, QA._stuck(t), deviation, texts, task="Task."), "session_id")
