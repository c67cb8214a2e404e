"""Queries over raw snapshots: decoding, typing, node resolution, scroll runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions.exprs import millis_to_seconds
from wayfold.operators import snapshots as S
from wayfold.plans import bindings as B
from wayfold.plans.registry import query
from wayfold.session import materialize

WITH = "WITH " + B.SNAPSHOTS_SQL


def _snapshots(t):
    return S.explode_snapshots(B.recordings(t), part="part")


def _parsed(t):
    """The tables of one pass over the recordings."""
    return S.parsed_tables(B.recordings(t), part="part")


def _fields(snapshots):
    return S.with_payload(snapshots)


def _typed(snapshots):
    return S.typed_events(_fields(snapshots))


def _timed(t):
    times, typed, _ = _parsed(t)
    starts = S.session_spans(times).select("session_id", "first_ms")
    return typed.join(starts, "session_id").withColumn("relative_s", millis_to_seconds(F.col("ts_ms") - F.col("first_ms")))


def _references(t, *kinds):
    """Pointer events and element definitions as stage tables."""
    _, typed, nodes = _parsed(t)
    return typed.filter(F.col("event_type").isin(*kinds)), nodes


@query("explode_snapshots", WITH + """
SELECT session_id, seq, ts_ms,
  CAST(CASE kind WHEN 'FULL_SNAPSHOT' THEN 2 WHEN 'PAGE_META' THEN 4 WHEN 'API_CALL' THEN 6 ELSE 3 END AS BIGINT) AS "type"
FROM snap""")
def explode_snapshots(t):
    return _snapshots(t).select("session_id", "seq", "ts_ms", F.col("type").cast("long").alias("type"))


@query("decode_payload", WITH + """
SELECT session_id, seq, kind <> 'BAD' AS readable,
  CASE WHEN kind IN ('MUTATION') THEN 0 WHEN kind = 'MOUSE_MOVE' THEN 1 WHEN kind IN ('CLICK', 'MOUSE_UP') THEN 2
       WHEN kind = 'SCROLL' THEN 3 WHEN kind = 'INPUT' THEN 5 END::BIGINT AS source
FROM snap""")
def decode_payload(t):
    return S.decode_payload(_snapshots(t)).select(
        "session_id", "seq", (F.col("payload") != "{}").alias("readable"),
        F.get_json_object("payload", "$.source").cast("long").alias("source"))


@query("classify_snapshot", WITH + "SELECT session_id, seq, kind AS event_type FROM typed")
def classify_snapshot(t):
    return S.classify_snapshot(_fields(_snapshots(t))).select("session_id", "seq", "event_type")


@query("relative_time", WITH + "SELECT session_id, seq, relative_s FROM snap")
def relative_time(t):
    return S.relative_time(materialize(_snapshots(t).select("session_id", "seq", "ts_ms"))).select("session_id", "seq", "relative_s")


NODES = """,
defs AS (SELECT session_id, seq, k AS node_id, 'div' AS tag, '/n/' || event_id AS href, 'c' || k AS "class", 'text ' || k AS "text"
         FROM snap WHERE kind IN ('FULL_SNAPSHOT', 'MUTATION')
         UNION ALL
         SELECT session_id, seq, k + 1000, 'span', '', '', '' FROM snap WHERE kind IN ('FULL_SNAPSHOT', 'MUTATION'))"""


@query("flatten_dom", WITH + NODES + """
SELECT session_id, seq, node_id, tag, href, "class", "text", CASE WHEN node_id >= 1000 THEN 1 ELSE 0 END::BIGINT AS depth FROM defs""")
def flatten_dom(t):
    return S.flatten_dom(_fields(_snapshots(t))).select("session_id", "seq", "node_id", "tag", "href", "class", "text", F.col("depth").cast("long").alias("depth"))


@query("resolve_node", WITH + NODES + """
SELECT r.session_id, r.seq, r.k AS node_id, coalesce(d.tag, 'unknown') AS tag, coalesce(d.href, '') AS href,
       coalesce(d."class", '') AS "class", coalesce(d."text", '') AS "text"
FROM (SELECT * FROM typed WHERE kind IN ('CLICK', 'INPUT')) r
ASOF LEFT JOIN defs d ON r.session_id = d.session_id AND r.k = d.node_id AND r.seq >= d.seq""")
def resolve_node(t):
    refs, nodes = _references(t, "CLICK", "INPUT")
    return S.resolve_node(refs, nodes).select("session_id", "seq", "node_id", "tag", "href", "class", "text")


@query("click_rows", WITH + NODES + """
SELECT r.session_id, r.seq, CAST(r.k AS DOUBLE) AS x, CAST(r.event_id % 1000 AS DOUBLE) AS y, coalesce(d.tag, 'unknown') AS tag
FROM (SELECT * FROM typed WHERE kind = 'CLICK') r
ASOF LEFT JOIN defs d ON r.session_id = d.session_id AND r.k = d.node_id AND r.seq >= d.seq""")
def click_rows(t):
    clicks, nodes = _references(t, "CLICK")
    return S.resolve_node(clicks, nodes).select("session_id", "seq", "x", "y", "tag")


@query("scroll_rows", WITH + """
SELECT session_id, seq, k AS node_id, y AS scroll_y, 0::BIGINT AS scroll_x FROM typed WHERE kind = 'SCROLL'""")
def scroll_rows(t):
    return _typed(_snapshots(t)).filter(F.col("event_type") == "SCROLL").select("session_id", "seq", "node_id", "scroll_y", "scroll_x")


@query("mouse_move_rows", WITH + """
SELECT session_id, seq, CAST(k AS DOUBLE) AS x, floor(value)::DOUBLE AS y, 2::BIGINT AS positions_count FROM typed WHERE kind = 'MOUSE_MOVE'""")
def mouse_move_rows(t):
    return _typed(_snapshots(t)).filter(F.col("event_type") == "MOUSE_MOVE").select("session_id", "seq", "x", "y", "positions_count")


@query("input_rows", WITH + """
SELECT session_id, seq, CASE WHEN k % 5 = 0 THEN k ELSE 2 * k END AS text_length, k % 5 = 0 AS is_masked FROM typed WHERE kind = 'INPUT'""")
def input_rows(t):
    return _typed(_snapshots(t)).filter(F.col("event_type") == "INPUT").select("session_id", "seq", "text_length", "is_masked")


@query("api_call_rows", WITH + """
SELECT session_id, seq, '/api/' || k AS path, '/api/' || k || '?u=' || session_id AS full_path,
       CASE WHEN digit = 4 THEN 'unknown' ELSE 'GET' END AS "method" FROM typed WHERE kind = 'API_CALL'""")
def api_call_rows(t):
    return _typed(_snapshots(t)).filter(F.col("event_type") == "API_CALL").select("session_id", "seq", "path", "full_path", "method")


@query("page_rows", WITH + """
SELECT session_id, seq, CASE kind WHEN 'PAGE_META' THEN '/page/' || k ELSE 'initial_page_load' END AS url,
       CASE WHEN kind = 'PAGE_META' THEN '1280x' || CASE WHEN digit = 2 THEN 'None' ELSE '720' END END AS viewport
FROM typed WHERE kind IN ('PAGE_META', 'FULL_SNAPSHOT')""")
def page_rows(t):
    return _typed(_snapshots(t)).filter(F.col("event_type").isin("PAGE_META", "FULL_SNAPSHOT")).select("session_id", "seq", "url", "viewport")


@query("api_paths", """
SELECT page_id, split_part(p, '?', 1) AS path, substr(p, 1, 150) AS full_path
FROM (SELECT page_id, list_extract(string_split(url, '.app'), -1) AS p FROM pages)""")
def api_paths(t):
    path = S.api_path(F.col("url"))
    return t.pages.select("page_id", F.substring_index(path, "?", 1).alias("path"), F.substring(path, 1, 150).alias("full_path"))


@query("text_entries", r"""
SELECT doc_id, CAST(length("text") AS BIGINT) AS text_length, regexp_matches("text", '^\*+$') AS is_masked
FROM documents WHERE length("text") > 0""")
def text_entries(t):
    text = F.col("text")
    return t.documents.filter(F.length(text) > 0).select(
        "doc_id", F.length(text).cast("long").alias("text_length"), text.rlike(r"^\*+\z").alias("is_masked"))


@query("session_header", WITH + """
SELECT s.session_id, s.duration AS session_duration_s, coalesce(n, 0) AS total_raw_events
FROM (SELECT session_id, arg_max(relative_s, seq) AS duration FROM snap GROUP BY 1) s
LEFT JOIN (SELECT session_id, count(*) AS n FROM typed GROUP BY 1) c USING (session_id)""")
def session_header(t):
    times, typed, _ = _parsed(t)
    return S.session_header(times, typed)


RUNS = """,
visible AS (
  SELECT *, sum(CASE WHEN kind = 'SCROLL' THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run
  FROM typed WHERE kind <> 'MOUSE_MOVE'),
runs AS (
  SELECT session_id, min(seq) AS seq, arg_min(relative_s, seq) AS "time", arg_min(y, seq) AS scroll_from, arg_max(y, seq) AS scroll_to,
    max(y) AS max_depth, (floor(arg_max(relative_s, seq) * 100 + 0.5) - floor(arg_min(relative_s, seq) * 100 + 0.5)) / 100 AS duration_s,
    CASE WHEN arg_max(y, seq) > arg_min(y, seq) THEN 'down' ELSE 'up' END AS direction
  FROM visible WHERE kind = 'SCROLL' GROUP BY session_id, run)"""


@query("collapse_scrolls", WITH + RUNS + "SELECT * FROM runs")
def collapse_scrolls(t):
    return S.collapse_scrolls(_timed(t)).drop("sub", "action")


@query("high_level_actions", WITH + NODES + RUNS + """,
direct AS (
  SELECT r.session_id, r.seq, r.relative_s AS "time", CASE r.kind WHEN 'INPUT' THEN 'TYPE' WHEN 'PAGE_META' THEN 'PAGE_LOAD' ELSE r.kind END AS action,
    CASE WHEN r.kind IN ('CLICK', 'INPUT') THEN coalesce(d.tag, 'unknown') END AS target_tag,
    CASE WHEN r.kind = 'CLICK' THEN coalesce(d."text", '') END AS target_text,
    CASE WHEN r.kind = 'CLICK' THEN coalesce(d.href, '') END AS target_href, CASE WHEN r.kind = 'CLICK' THEN coalesce(d."class", '') END AS target_class,
    CASE WHEN r.kind = 'CLICK' THEN CAST(r.k AS DOUBLE) END AS x, CASE WHEN r.kind = 'CLICK' THEN CAST(r.event_id % 1000 AS DOUBLE) END AS y,
    CASE WHEN r.kind = 'INPUT' THEN CASE WHEN r.k % 5 = 0 THEN r.k ELSE 2 * r.k END END AS text_length, CASE WHEN r.kind = 'INPUT' THEN r.k % 5 = 0 END AS is_masked,
    CASE WHEN r.kind = 'INPUT' THEN '' END AS target_placeholder,
    CASE WHEN r.kind = 'PAGE_META' THEN '/page/' || r.k END AS url, CASE WHEN r.kind = 'PAGE_META' THEN '1280x' || CASE WHEN r.digit = 2 THEN 'None' ELSE '720' END END AS viewport,
    CASE WHEN r.kind = 'API_CALL' THEN '/api/' || r.k END AS path, CASE WHEN r.kind = 'API_CALL' THEN '/api/' || r.k || '?u=' || r.session_id END AS full_path,
    NULL::BIGINT AS scroll_from, NULL::BIGINT AS scroll_to, NULL::BIGINT AS max_depth, NULL::DOUBLE AS duration_s, NULL::VARCHAR AS direction
  FROM (SELECT * FROM typed WHERE kind IN ('CLICK', 'INPUT', 'API_CALL', 'PAGE_META')) r
  ASOF LEFT JOIN defs d ON r.session_id = d.session_id AND r.k = d.node_id AND r.seq >= d.seq)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS step, * EXCLUDE (session_id, seq)
FROM (SELECT * FROM direct UNION ALL BY NAME
      SELECT session_id, seq, "time", 'SCROLL' AS action, scroll_from, scroll_to, max_depth, duration_s, direction FROM runs)""")
def high_level_actions(t):
    """All columns of the action table, in one pass over the recordings."""
    actions, _ = S.parse_recordings(B.recordings(t), part="part")
    return actions


PROFILE_SQL = """
SELECT event_id, 'os' || (json_extract_string(props, '$.k')::BIGINT % 3) AS os, event_type AS country,
       value AS viewport_width, NULL::VARCHAR AS age_group
FROM events"""


@query("user_profile", PROFILE_SQL)
def user_profile(t):
    """Person properties written as JSON per event and read back through the profile schema."""
    from wayfold.schemas import PERSON

    k = F.get_json_object("props", "$.k").cast("long")
    person = F.to_json(F.struct(F.struct(
        F.concat(F.lit("os"), F.pmod(k, F.lit(3)).cast("string")).alias("$os"),
        F.col("event_type").alias("country"), F.col("value").alias("$viewport_width")).alias("properties")))
    people = t.events.select(F.col("event_id").alias("session_id"), F.from_json(person, PERSON).alias("person"))
    return S.user_profile(people).select(F.col("session_id").alias("event_id"), "os", "country", "viewport_width", "age_group")
