"""Queries over flat-event sessions, stored artifacts and other input shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import flat as FT
from wayfold.operators.batches import score_batches
from wayfold.plans import bindings as B
from wayfold.plans.registry import query
from wayfold.sources import readers as RD

KINDS = ["click", "rage_click", "dead_click", "scroll", "hover", "hesitation", "input", "type", "page_load", "mouse_move"]
KIND_SQL = "CASE k % 10 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(KINDS)) + " END"


def _flat(t):
    """Events as flat-session events: ``k`` picks the kind, every kind and null case occurs."""
    k = F.col("k")
    ks = k.cast("string")
    kind = F.element_at(F.array(*[F.lit(n) for n in KINDS]), (F.pmod(k, F.lit(10)) + 1).cast("int"))
    odd = F.pmod("event_id", F.lit(2)) == 1
    return B.events(t).select(
        "session_id", "event_id", "us", kind.alias("event_type"), (F.floor(F.col("us") / 1000)).cast("double").alias("timestamp"),
        F.when(odd, F.col("value")).alias("x"), F.when(odd, k.cast("double")).alias("y"),
        F.when(odd, F.concat(F.lit("..box."), ks)).alias("target_selector"), F.when(odd, F.lit("div")).alias("target_tag"), F.when(odd, F.concat(F.lit("t"), ks)).alias("target_text"),
        F.when(F.pmod("event_id", F.lit(5)) != 0, F.floor("value").cast("double")).alias("scroll_y"), F.when(odd, F.col("value")).alias("hover_duration_ms"),
        F.when(odd, F.lit(1366.0)).alias("viewport_width"), F.lit(768.0).alias("viewport_height"), F.concat(F.lit("/p"), ks).alias("url"),
        F.concat(F.lit("word "), ks).alias("text"), F.when(odd, k).alias("text_length"), F.when(odd, F.lit(True)).alias("is_masked"), F.when(odd, F.lit("name")).alias("placeholder"))


FLAT_SQL = "WITH " + B.EVENTS_SQL + f""",
f0 AS (SELECT *, {KIND_SQL} AS kind, us // 1000 AS ms, event_id % 2 = 1 AS odd, first_value(us // 1000) OVER w AS ms0 FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id)),
f1 AS (SELECT *, CASE WHEN kind = 'scroll' THEN CASE WHEN event_id % 5 <> 0 THEN floor(value) ELSE 0 END END AS y1 FROM f0),
f2 AS (SELECT *, coalesce(last_value(y1 IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y0 FROM f1),
flat AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY us, event_id) AS step, floor((ms - ms0)::DOUBLE / 1000 * 100 + 0.5) / 100 AS "time",
    CASE WHEN kind IN ('click', 'rage_click', 'dead_click', 'hover', 'hesitation') THEN 'CLICK' WHEN kind = 'scroll' THEN 'SCROLL' WHEN kind IN ('input', 'type') THEN 'TYPE' ELSE 'PAGE_LOAD' END AS action,
    CASE WHEN kind = 'hesitation' THEN 'page' WHEN kind IN ('input', 'type') THEN CASE WHEN odd THEN 'div' ELSE 'input' END WHEN kind IN ('scroll', 'page_load') THEN NULL WHEN odd THEN 'div' ELSE '' END AS target_tag,
    CASE kind WHEN 'click' THEN CASE WHEN odd THEN 't' || k ELSE '' END WHEN 'rage_click' THEN CASE WHEN odd THEN 't' || k || ' ' ELSE '' END || '[RAGE CLICK]'
      WHEN 'dead_click' THEN CASE WHEN odd THEN 't' || k || ' ' ELSE '' END || '[DEAD CLICK]' WHEN 'hover' THEN CASE WHEN odd THEN 't' || k ELSE '' END || ' [HOVER ' || CASE WHEN odd THEN floor(value + 0.5)::BIGINT ELSE 0 END || 'ms]'
      WHEN 'hesitation' THEN '[HESITATION ' || CASE WHEN odd THEN floor(value + 0.5)::BIGINT ELSE 0 END || 'ms]' END AS target_text,
    CASE WHEN kind IN ('click', 'rage_click', 'dead_click', 'hover') THEN CASE WHEN odd THEN 'box.' || k ELSE '' END WHEN kind = 'hesitation' THEN '' END AS target_class,
    CASE WHEN kind IN ('click', 'rage_click', 'dead_click', 'hover') THEN CASE WHEN odd THEN trunc(value) ELSE 0 END WHEN kind = 'hesitation' THEN 0 END::DOUBLE AS x,
    CASE WHEN kind = 'scroll' THEN y0::BIGINT END AS scroll_from, y1::BIGINT AS scroll_to, CASE WHEN kind = 'scroll' THEN greatest(y0, y1)::BIGINT END AS max_depth,
    CASE WHEN kind = 'scroll' THEN CASE WHEN y1 >= y0 THEN 'down' ELSE 'up' END END AS direction,
    CASE WHEN kind IN ('input', 'type') THEN CASE WHEN odd THEN k ELSE length('word ' || k) END END AS text_length, CASE WHEN kind IN ('input', 'type') THEN odd END AS is_masked,
    CASE WHEN kind = 'page_load' THEN '/p' || k END AS url, CASE WHEN kind = 'page_load' THEN CASE WHEN odd THEN '1366.0' ELSE '0' END || 'x768.0' END AS viewport
  FROM f2 WHERE kind <> 'mouse_move')
"""
COLUMNS = ["session_id", "step", "time", "action", "target_tag", "target_text", "target_class", "x", "scroll_from", "scroll_to", "max_depth", "direction", "text_length", "is_masked", "url", "viewport"]


def _actions(t):
    return FT.normalize_flat_event(_flat(t), ["us", "event_id"])


@query("normalize_flat_event", FLAT_SQL + "SELECT * FROM flat")
def normalize_flat_event(t):
    return _actions(t).select(*COLUMNS)


@query("flat_scroll_delta", FLAT_SQL + "SELECT session_id, step, scroll_from, scroll_to, max_depth, direction FROM flat WHERE action = 'SCROLL'")
def flat_scroll_delta(t):
    return _actions(t).filter("action = 'SCROLL'").select("session_id", "step", "scroll_from", "scroll_to", "max_depth", "direction")


@query("union_inputs", "WITH " + B.ACTIONS_SQL + "," + FLAT_SQL[len("WITH " + B.EVENTS_SQL) + 1:] + """
SELECT action, count(*) AS n, count(target_text) AS texts, sum(step)::BIGINT AS steps FROM (SELECT action, target_text, step FROM actions UNION ALL SELECT action, target_text, step FROM flat) GROUP BY 1""")
def union_inputs(t):
    both = FT.union_inputs(B.actions(t), _actions(t))
    return both.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count("target_text").alias("texts"), F.sum("step").alias("steps"))


@query("flat_profile", """
SELECT c_custkey AS session_id, CASE WHEN c_nationkey > 0 THEN coalesce(CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment END, 'unknown') END AS age_group,
  CASE WHEN c_nationkey > 0 THEN CASE WHEN c_nationkey % 4 = 0 THEN 'unknown' ELSE 'ua' || c_nationkey END END AS browser, CASE WHEN c_nationkey > 0 THEN 'desktop' END AS device_type,
  CASE WHEN c_nationkey > 0 THEN CASE WHEN c_nationkey % 5 = 0 THEN 1920.0 ELSE c_nationkey END END::DOUBLE AS viewport_width, floor(abs(c_acctbal) / 1000.0::DOUBLE * 10 + 0.5) / 10 AS session_duration_s,
  c_nationkey::BIGINT AS total_raw_events FROM customer""")
def flat_profile(t):
    n = F.col("c_nationkey")
    sessions = t.customer.select(
        F.col("c_custkey").alias("session_id"), n.alias("event_count"), F.when(F.pmod(n, F.lit(3)) != 0, F.col("c_mktsegment")).alias("age_group"), F.lit(None).cast("string").alias("country"),
        F.when(F.pmod(n, F.lit(8)) == 0, F.lit("imported")).when(F.pmod(n, F.lit(4)) != 0, F.concat(F.lit("ua"), n.cast("string"))).alias("user_agent"),
        F.lit(None).cast("string").alias("device_type"), F.when(F.pmod(n, F.lit(5)) != 0, n.cast("double")).alias("viewport_width"), F.lit(None).cast("double").alias("viewport_height"),
        F.abs("c_acctbal").alias("duration_ms"))
    return FT.flat_profile(sessions).select("session_id", "age_group", "browser", "device_type", "viewport_width", "session_duration_s", "total_raw_events")


@query("read_snapshot_lines", """
SELECT event_id, epoch_us(ts) // 1000 AS "timestamp", 3::BIGINT AS "type", CASE WHEN k % 4 = 0 THEN 'w' || user_id WHEN k % 4 = 1 THEN 'own' END AS window_id, '{"k":' || k || '}' AS data
FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) WHERE k % 5 <> 4""")
def read_snapshot_lines(t):
    """Events written as snapshot lines of every form (pair, bare, blank, broken) and parsed back."""
    k = F.get_json_object("props", "$.k").cast("long")
    m = F.pmod(k, F.lit(4))
    snap = F.to_json(F.struct(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("timestamp"), F.lit(3).alias("type"), F.struct(k.alias("k")).alias("data"),
                              F.when(m == 1, F.lit("own")).alias("windowId")))
    pair = F.concat(F.lit('["w'), F.col("user_id").cast("string"), F.lit('", '), snap, F.lit("]"))
    line = F.when(F.pmod(k, F.lit(5)) == 4, F.when(m == 0, F.lit("")).when(m == 1, F.lit("   ")).otherwise(F.concat(snap, F.lit('"')))).when(m <= 1, pair).otherwise(snap)
    return RD.parse_snapshot_lines(t.events.select("event_id", line.alias("value"))).select(
        "event_id", "timestamp", F.col("type").cast("long").alias("type"), F.col("windowId").alias("window_id"), "data")


@query("read_policies", """
SELECT event_id, CASE WHEN k % 3 = 0 THEN 'linear' ELSE 'focused' END AS navigation_style, k / 100.0::DOUBLE AS comment_probability, event_type || '>open_post>' || CASE WHEN k % 2 = 0 THEN 'vote_on_post' ELSE 'signup' END AS sequence
FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""")
def read_policies(t):
    """Policies whose action sequence mixes names and objects."""
    k = F.get_json_object("props", "$.k").cast("long")
    last = F.when(F.pmod(k, F.lit(2)) == 0, F.lit('{"action": "vote_on_post", "why": "likes it"}')).otherwise(F.lit('"signup"'))
    text = F.concat(
        F.lit('{"navigation_style": "'), F.when(F.pmod(k, F.lit(3)) == 0, F.lit("linear")).otherwise(F.lit("focused")), F.lit('", "post_interaction": {"comment_probability": '),
        (k / 100.0).cast("string"), F.lit('}, "action_sequence": ["'), "event_type", F.lit('", {"action": "open_post"}, '), last, F.lit("]}"))
    got = RD.parse_policies(t.events.select("event_id", text.alias("value")))
    return got.select("event_id", "navigation_style", F.col("post_interaction.comment_probability").alias("comment_probability"), F.array_join("action_sequence", ">").alias("sequence"))


@query("inventory", """
WITH f AS (SELECT ['recordings', 'parsed', 'descriptions', 'embeddings', 'clusters', 'training', 'models', 'reports'] AS names),
n AS (SELECT unnest(names) AS folder, generate_subscripts(names, 1) AS i FROM f),
c AS (SELECT c_nationkey % 7 + 1 AS i, count(*) FILTER (WHERE c_custkey % 10 <> 0) AS files FROM customer GROUP BY 1)
SELECT folder, coalesce(files, 0) AS files, coalesce(files, 0) > 0 AS done FROM n LEFT JOIN c USING (i)""")
def inventory(t):
    """Customers as file names: folder by nation, hidden files where the key ends in 0."""
    names = F.array(*[F.lit(n) for n in RD.ARTIFACTS])
    folder = F.element_at(names, F.pmod("c_nationkey", F.lit(7)) + 1)
    name = F.when(F.pmod("c_custkey", F.lit(10)) == 0, F.concat(F.lit("."), "c_name")).otherwise(F.col("c_name"))
    return RD.count_artifacts(t.customer, folder, name).select("folder", "files", "done")


@query("score_batches", """SELECT doc_id, CASE WHEN lang <> 'de' THEN 'len ' || length("text") END AS result, CASE WHEN lang = 'de' THEN 'unsupported language' END AS error,
  CASE WHEN lang = 'fr' THEN 2 ELSE 1 END::BIGINT AS attempts FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def score_batches_query(t):
    """A stand-in model: one language always fails, another is rate limited once."""
    limited = {}

    def model(text):
        lang, _, body = text.partition("|")
        if lang == "de":
            raise ValueError("unsupported language")
        if lang == "fr" and not limited.pop(text, False):
            limited[text] = True
            raise RuntimeError("429 slow down")
        return f"len {len(body)}"

    texts = t.documents.select("doc_id", F.concat_ws("|", "lang", "text").alias("text"))
    return score_batches(texts, model, "text", "doc_id", done=t.labels.filter("toxic = 1"), sleep=lambda s: None)
