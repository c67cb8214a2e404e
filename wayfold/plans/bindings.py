"""The driver tables seen as the library's inputs, and the same views as SQL text.

Every view covers its whole table.  ``events`` stands for sessions (one per user, ordered by
``ts, event_id``); its ``props.k`` gives element ids, texts and outcomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.exprs import div, epoch_micros
from wayfold.operators.sequence import Sequence
from wayfold.operators.snapshots import PART_ROWS
from wayfold.plans.registry import Tables


def events(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("session_id"),
        "event_id",
        epoch_micros(F.col("ts")).alias("us"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


EVENTS_SQL = """
ev AS (
  SELECT user_id AS session_id, event_id, epoch_us(ts) AS us, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""


def ordered(df: DataFrame) -> Sequence:
    """Ordered columns over event rows."""
    return Sequence(df, ["session_id"], ["us", "event_id"])


def _when(pairs: dict[str, Column | str]) -> Column:
    kind = F.col("event_type")
    out = None
    for name, value in pairs.items():
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


def actions(t: Tables) -> DataFrame:
    """The action table: click -> CLICK, view -> SCROLL, signup -> TYPE, purchase -> API_CALL, error -> PAGE_LOAD."""
    k = F.col("k")
    y = F.when(F.col("event_type") == "view", F.floor("value").cast("long"))
    ms = div(F.col("us"), 1000)
    rows = (
        ordered(events(t))
        .number("step")
        .first("_ms0", ms)
        .last_known("_last_y", y, inclusive=False)
        .build()
        .withColumns({"_y": y, "_from": F.coalesce("_last_y", F.lit(0)), "_ks": k.cast("string")})
    )
    scroll = F.col("event_type") == "view"
    click = F.col("event_type") == "click"
    typed = F.col("event_type") == "signup"
    call = F.concat(F.lit("/api/"), F.col("_ks"))
    return rows.select(
        "session_id",
        "step",
        (div(ms - F.col("_ms0") + 5, 10) / F.lit(100.0)).alias("time"),
        _when({"click": "CLICK", "view": "SCROLL", "signup": "TYPE", "purchase": "API_CALL", "error": "PAGE_LOAD"}).alias("action"),
        F.when(click, F.when(F.pmod(k, F.lit(3)) == 0, F.lit("button")).otherwise(F.lit("a"))).when(typed, F.lit("input")).alias("target_tag"),
        F.when(click, F.when(F.pmod(k, F.lit(4)) == 0, F.lit("")).otherwise(F.concat(F.lit("item "), "_ks"))).alias("target_text"),
        F.when(click, F.when(F.pmod(k, F.lit(2)) == 0, F.concat(F.lit("/p/"), "_ks")).otherwise(F.lit(""))).alias("target_href"),
        F.when(click, F.concat(F.lit("c"), F.pmod(k, F.lit(10)).cast("string"))).alias("target_class"),
        F.when(click, k.cast("double")).alias("x"),
        F.when(click, F.pmod("event_id", F.lit(1000)).cast("double")).alias("y"),
        F.when(scroll, F.col("_from")).alias("scroll_from"),
        F.when(scroll, F.col("_y")).alias("scroll_to"),
        F.when(scroll, F.greatest("_y", "_from")).alias("max_depth"),
        F.when(scroll, F.lit(0.5)).alias("duration_s"),
        F.when(scroll, F.when(F.col("_y") >= F.col("_from"), F.lit("down")).otherwise(F.lit("up"))).alias("direction"),
        F.when(typed, k).alias("text_length"),
        F.when(typed, F.pmod(k, F.lit(5)) == 0).alias("is_masked"),
        F.when(typed, F.when(F.pmod(k, F.lit(2)) == 0, F.lit("field")).otherwise(F.lit(""))).alias("target_placeholder"),
        F.when(F.col("event_type") == "purchase", call).alias("path"),
        F.when(F.col("event_type") == "purchase", F.concat(call, F.lit("?u="), F.col("session_id").cast("string"))).alias("full_path"),
        F.when(F.col("event_type") == "error", F.concat(F.when(F.pmod(k, F.lit(7)) == 0, F.lit("/back/")).otherwise(F.lit("/page/")), "_ks")).alias("url"),
        F.when(F.col("event_type") == "error", F.lit("1280x720")).alias("viewport"),
    )


ACTIONS_SQL = EVENTS_SQL + """,
act0 AS (
  SELECT *, row_number() OVER w AS step, us // 1000 - first_value(us // 1000) OVER w AS d_ms,
         CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) END AS y1
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id)),
act1 AS (
  SELECT *, coalesce(last_value(y1 IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY step
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y0
  FROM act0),
actions AS (
  SELECT session_id, step, ((d_ms + 5) // 10) / 100.0 AS time,
    CASE event_type WHEN 'click' THEN 'CLICK' WHEN 'view' THEN 'SCROLL' WHEN 'signup' THEN 'TYPE'
                    WHEN 'purchase' THEN 'API_CALL' WHEN 'error' THEN 'PAGE_LOAD' END AS action,
    CASE event_type WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'button' ELSE 'a' END WHEN 'signup' THEN 'input' END AS target_tag,
    CASE WHEN event_type = 'click' THEN CASE WHEN k % 4 = 0 THEN '' ELSE 'item ' || k END END AS target_text,
    CASE WHEN event_type = 'click' THEN CASE WHEN k % 2 = 0 THEN '/p/' || k ELSE '' END END AS target_href,
    CASE WHEN event_type = 'click' THEN 'c' || (k % 10) END AS target_class,
    CASE WHEN event_type = 'click' THEN CAST(k AS DOUBLE) END AS x,
    CASE WHEN event_type = 'click' THEN CAST(event_id % 1000 AS DOUBLE) END AS y,
    CASE WHEN event_type = 'view' THEN y0 END AS scroll_from,
    y1 AS scroll_to,
    CASE WHEN event_type = 'view' THEN greatest(y0, y1) END AS max_depth,
    CASE WHEN event_type = 'view' THEN 0.5::DOUBLE END AS duration_s,
    CASE WHEN event_type = 'view' THEN CASE WHEN y1 >= y0 THEN 'down' ELSE 'up' END END AS direction,
    CASE WHEN event_type = 'signup' THEN k END AS text_length,
    CASE WHEN event_type = 'signup' THEN k % 5 = 0 END AS is_masked,
    CASE WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN 'field' ELSE '' END END AS target_placeholder,
    CASE WHEN event_type = 'purchase' THEN '/api/' || k END AS path,
    CASE WHEN event_type = 'purchase' THEN '/api/' || k || '?u=' || session_id END AS full_path,
    CASE WHEN event_type = 'error' THEN CASE WHEN k % 7 = 0 THEN '/back/' ELSE '/page/' END || k END AS url,
    CASE WHEN event_type = 'error' THEN '1280x720' END AS viewport
  FROM act1)"""


def agent_actions(t: Tables) -> DataFrame:
    """The agent log: the event kind names the action, ``value`` is its duration, ``k`` its outcome."""
    k = F.col("k")
    failed = F.pmod(k, F.lit(5)) == 0
    ms = div(F.col("us"), 1000)
    rows = ordered(events(t)).number("step").first("_ms0", ms).build()
    return rows.select(
        "session_id",
        "step",
        _when({"click": "open_post", "view": "scan_feed", "signup": "write_comment", "purchase": "vote_on_post", "error": "browse_subreddit"}).alias("action_name"),
        (F.col("us") / F.lit(1_000_000.0)).alias("timestamp"),
        (div(ms - F.col("_ms0") + 5, 10) / F.lit(100.0)).alias("relative_s"),
        F.col("value").alias("duration_s"),
        (~failed).alias("success"),
        F.when(failed, F.concat(F.lit("error "), k.cast("string"))).otherwise(F.lit("")).alias("error"),
        F.when(F.pmod(k, F.lit(20)) == 0, F.lit("")).when(F.pmod(k, F.lit(20)) == 1, F.lit("unknown"))
        .otherwise(F.concat(F.lit("/p/"), F.pmod(k, F.lit(20)).cast("string"))).alias("page_url"),
        F.when(F.pmod(k, F.lit(6)) == 0, F.lit("")).otherwise(F.concat(F.lit("target "), k.cast("string"))).alias("target"),
        (F.pmod(k, F.lit(7)) == 0).alias("skipped"),
        _when({"click": "click", "view": "scroll", "signup": "type", "purchase": "wait", "error": "navigate_back"}).alias("action"),
        k.alias("k"),
    )


AGENT_SQL = EVENTS_SQL + """,
agent AS (
  SELECT session_id, row_number() OVER w AS step,
    CASE event_type WHEN 'click' THEN 'open_post' WHEN 'view' THEN 'scan_feed' WHEN 'signup' THEN 'write_comment'
                    WHEN 'purchase' THEN 'vote_on_post' WHEN 'error' THEN 'browse_subreddit' END AS action_name,
    us / 1000000.0 AS "timestamp",
    ((us // 1000 - first_value(us // 1000) OVER w + 5) // 10) / 100.0 AS relative_s,
    value AS duration_s, k % 5 <> 0 AS success,
    CASE WHEN k % 5 = 0 THEN 'error ' || k ELSE '' END AS error,
    CASE WHEN k % 20 = 0 THEN '' WHEN k % 20 = 1 THEN 'unknown' ELSE '/p/' || (k % 20) END AS page_url,
    CASE WHEN k % 6 = 0 THEN '' ELSE 'target ' || k END AS target,
    k % 7 = 0 AS skipped, k,
    CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'scroll' WHEN 'signup' THEN 'type' WHEN 'purchase' THEN 'wait' ELSE 'navigate_back' END AS action
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id))"""


def stored_actions(t: Tables) -> DataFrame:
    """The action table as a stored stage, for queries that read it more than once."""
    return t.stage("actions", actions)


def stored_agent_log(t: Tables) -> DataFrame:
    """The agent log as a stored stage, as logs are files in practice."""
    return t.stage("agent_log", agent_actions)


def snapshot_rows(t: Tables) -> DataFrame:
    """Events written as replay snapshots, ``data`` holding JSON text; file order is ``event_id``."""
    k, y = F.col("k"), F.floor("value").cast("long")
    kind, digit = F.col("event_type"), F.pmod("k", F.lit(10))
    ks = k.cast("string")
    node = F.struct(
        k.alias("id"), F.lit("div").alias("tagName"), F.lit(2).alias("type"),
        F.struct(F.concat(F.lit("c"), ks).alias("class"), F.concat(F.lit("/n/"), F.col("event_id").cast("string")).alias("href")).alias("attributes"),
        F.array(
            F.struct((k + 1000).alias("id"), F.lit("span").alias("tagName"), F.lit(3).alias("type"),
                     F.concat(F.lit(" text "), ks, F.lit(" ")).alias("textContent")),
        ).alias("childNodes"),
    )
    full = (kind == "view") & (digit == 7)
    moves = (kind == "view") & (digit == 3)
    scroll = (kind == "view") & ~full & ~moves
    mutation = (kind == "error") & (digit == 1)
    meta = (kind == "error") & ~mutation
    request = F.struct(
        F.concat(F.lit("https://x.app/api/"), ks, F.lit("?u="), F.col("session_id").cast("string")).alias("name"),
        F.when(digit != 4, F.lit("GET")).alias("method"),
    )
    other = F.struct(F.concat(F.lit("/static/"), ks).alias("name"), F.lit("GET").alias("method"))
    payload = (
        F.when(full, F.to_json(F.struct(node.alias("node"))))
        .when(moves, F.to_json(F.struct(F.lit(1).alias("source"), F.array(
            F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")), F.struct(k.alias("x"), y.alias("y"))).alias("positions"))))
        .when(scroll, F.to_json(F.struct(F.lit(3).alias("source"), k.alias("id"), F.when(digit != 5, y).alias("y"))))
        .when(mutation, F.to_json(F.struct(F.lit(0).alias("source"), F.array(F.struct(node.alias("node"))).alias("adds"))))
        .when(meta, F.to_json(F.struct(F.concat(F.lit("/page/"), ks).alias("href"), F.lit(1280).alias("width"), F.when(digit != 2, F.lit(720)).alias("height"))))
        .when((kind == "click") & (digit == 9), F.lit("not json"))
        .when(kind == "click", F.to_json(F.struct(F.lit(2).alias("source"), F.when(digit == 8, F.lit(1)).otherwise(F.lit(2)).alias("type"),
                                                  k.alias("id"), k.alias("x"), F.pmod("event_id", F.lit(1000)).alias("y"))))
        .when(kind == "signup", F.to_json(F.struct(F.lit(5).alias("source"), k.alias("id"),
                                                   F.repeat(F.when(F.pmod(k, F.lit(5)) == 0, F.lit("*")).otherwise(F.lit("a*")), k.cast("int")).alias("text"))))
        .when(kind == "purchase", F.to_json(F.struct(F.struct(F.array(request, other).alias("requests")).alias("payload"))))
    )
    stype = (
        F.when(full, F.lit(2)).when(meta, F.lit(4)).when(kind == "purchase", F.lit(6)).otherwise(F.lit(3))
    )
    return events(t).select("session_id", "event_id", div(F.col("us"), 1000).alias("timestamp"), stype.alias("type"), payload.alias("data"))


def recordings(t: Tables) -> DataFrame:
    """Snapshot rows packed into recording parts of at most ``PART_ROWS``, as the files would hold them."""
    item = F.struct("event_id", "timestamp", "type", "data")
    return (
        snapshot_rows(t)
        .withColumn("part", div(F.col("event_id"), PART_ROWS))
        .groupBy("session_id", "part")
        .agg(F.transform(F.array_sort(F.collect_list(item)),
                         lambda s: F.struct(s["timestamp"].alias("timestamp"), s["type"].alias("type"), s["data"].alias("data"))).alias("snapshots"))
    )


SNAPSHOTS_SQL = EVENTS_SQL + """,
snap AS (
  SELECT session_id, event_id, (event_id // 1000) * 1000 + row_number() OVER (PARTITION BY session_id, event_id // 1000 ORDER BY event_id) - 1 AS seq,
    us // 1000 AS ts_ms, k, k % 10 AS digit, value,
    CASE WHEN event_type = 'view' AND k % 10 = 7 THEN 'FULL_SNAPSHOT'
         WHEN event_type = 'view' AND k % 10 = 3 THEN 'MOUSE_MOVE'
         WHEN event_type = 'view' THEN 'SCROLL'
         WHEN event_type = 'error' AND k % 10 = 1 THEN 'MUTATION'
         WHEN event_type = 'error' THEN 'PAGE_META'
         WHEN event_type = 'click' AND k % 10 = 9 THEN 'BAD'
         WHEN event_type = 'click' AND k % 10 = 8 THEN 'MOUSE_UP'
         WHEN event_type = 'click' THEN 'CLICK'
         WHEN event_type = 'signup' THEN 'INPUT'
         WHEN event_type = 'purchase' THEN 'API_CALL' END AS kind,
    CASE WHEN k % 10 = 5 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS y,
    ((us // 1000 - first_value(us // 1000) OVER w + 5) // 10) / 100.0 AS relative_s
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY event_id)),
typed AS (
  SELECT * FROM snap
  WHERE kind NOT IN ('MUTATION', 'BAD', 'MOUSE_UP') AND NOT (kind = 'INPUT' AND k = 0))"""


def action_kinds(t: Tables) -> DataFrame:
    """``(session_id, action)`` of the action table, for counts that need no order."""
    return t.events.select(
        F.col("user_id").alias("session_id"),
        _when({"click": "CLICK", "view": "SCROLL", "signup": "TYPE", "purchase": "API_CALL", "error": "PAGE_LOAD"}).alias("action"),
    )


def agent_sequences(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(planned, actual) action sequences ``(session_id, pos, action)``: the plan is what the user before did."""
    actual = ordered(events(t)).number("pos").build().select("session_id", "pos", F.col("event_type").alias("action"))
    return actual.withColumn("session_id", F.col("session_id") + 1), actual


SEQUENCES_SQL = EVENTS_SQL + """,
actual AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY us, event_id) AS pos, event_type AS action FROM ev),
planned AS (SELECT session_id + 1 AS session_id, pos, action FROM actual)"""
