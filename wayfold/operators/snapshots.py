"""Raw replay snapshots -> typed events -> high-level actions."""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.exprs import millis_to_seconds, seconds_between
from wayfold.functions.text import json_object
from wayfold.operators.sequence import Sequence
from wayfold.schemas import ACTION_COLUMNS, PAYLOAD
from wayfold.session import materialize, materialize_by

PART_ROWS = 1_000
"""Snapshots per part when one long recording is stored as several rows."""

# Fixed values of the snapshot format.
FULL_SNAPSHOT, INCREMENTAL, META, PLUGIN = 2, 3, 4, 6
MUTATION, MOUSE_MOVE, MOUSE_INTERACTION, SCROLL, INPUT = 0, 1, 2, 3, 5
CLICK_INTERACTION = 2
GZIP_MARK = "\x1f\x8b"

NODE_TYPE = (
    "array<struct<node_id: bigint, tag: string, class: string, href: string, type_attr: string, "
    "placeholder: string, text: string, depth: int>>"
)


_NODE = NODE_TYPE.removeprefix("array<").removesuffix(">")
_EVENT = (
    "struct<sub: bigint, event_type: string, node_id: bigint, x: double, y: double, scroll_x: bigint, scroll_y: bigint, positions_count: bigint, "
    "text_length: bigint, is_masked: boolean, url: string, viewport: string, path: string, full_path: string, method: string>"
)


def explode_snapshots(recordings: DataFrame, part: str | None = None) -> DataFrame:
    """One row per snapshot; ``seq`` is its position in file order.

    A part with more than ``PART_ROWS`` snapshots is refused: its positions would run into the next part's.
    """
    offset, snapshots = F.lit(0), F.col("snapshots")
    if part:
        offset = F.col(part) * F.lit(PART_ROWS)
        too_long = F.raise_error(F.concat(F.lit(f"a recording part holds at most {PART_ROWS} snapshots, not "), F.size(snapshots).cast("string")))
        snapshots = F.when(F.size(snapshots) <= PART_ROWS, snapshots).when(snapshots.isNotNull(), too_long.cast(recordings.schema["snapshots"].dataType))
    exploded = recordings.select("session_id", offset.alias("_offset"), F.posexplode(snapshots).alias("_pos", "_snap"))
    return exploded.select(
        "session_id",
        (F.col("_offset") + F.col("_pos")).cast("long").alias("seq"),
        F.col("_snap.timestamp").alias("ts_ms"),
        F.col("_snap.type").alias("type"),
        F.col("_snap.data").alias("data"),
    )


def _gunzip(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return gzip.decompress(text.encode("latin-1")).decode("utf-8")
    except (OSError, EOFError, ValueError, zlib.error):
        return None


def _inflate(payload: pd.Series) -> pd.Series:
    return payload.map(_gunzip)


def decode_payload(snapshots: DataFrame, data: str = "data", name: str = "payload") -> DataFrame:
    """JSON text of the payload: inflated when gzipped, ``{}`` when unreadable.

    Only the text of gzip-marked rows is sent to Python; plain payloads stay in the JVM.
    """
    marked = F.coalesce(F.col(data).startswith(GZIP_MARK), F.lit(False))
    plain = F.when(~marked, F.col(data))
    inflated = F.when(marked, F.pandas_udf(_inflate, "string")(F.when(marked, F.col(data))))
    return snapshots.withColumn(name, F.coalesce(json_object(F.coalesce(inflated, plain)), F.lit("{}")))


def with_payload(snapshots: DataFrame, data: str = "data") -> DataFrame:
    """Adds the payload ``p``, parsed once and strictly: an unreadable one has null fields.

    Inside brackets, a text that is not exactly one JSON value gives no list of one element, so validity needs
    no parse of its own.  Parsing sits in a generator, as in ``with_fields``.
    """
    marked = F.coalesce(F.col(data).startswith(GZIP_MARK), F.lit(False))
    inflated = F.when(marked, F.pandas_udf(_inflate, "string")(F.when(marked, F.col(data))))
    rest = [c for c in snapshots.columns if c != data]
    text = snapshots.select(*rest, F.trim(F.coalesce(inflated, F.when(~marked, F.col(data))), F.lit(" \n\r\t")).alias("_text"))
    whole = F.when(F.col("_text").startswith("{") & F.col("_text").endswith("}"), F.concat(F.lit("["), F.col("_text"), F.lit("]")))
    parsed = text.select(*rest, F.explode(F.array(F.struct(F.from_json(whole, f"array<struct<{PAYLOAD}>>").alias("list")))).alias("_p"))
    return parsed.select(*rest, F.when(F.size("_p.list") == 1, F.get("_p.list", F.lit(0))).alias("p"))


def with_fields(snapshots: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds the parsed payload ``p``.

    Parsing sits in a generator because filters on ``p`` are then applied to its result; on a plain
    column they would be pushed below it and parse the text again for every condition.
    """
    rest = [c for c in snapshots.columns if c != payload]
    return snapshots.select(*rest, F.explode(F.array(F.from_json(payload, PAYLOAD))).alias("p"))


def event_type(type_: Column, source: Column, interaction: Column) -> Column:
    """Typed event kind; null for combinations that carry no user behaviour."""
    incremental = (
        F.when((source == MOUSE_INTERACTION) & (interaction == CLICK_INTERACTION), F.lit("CLICK"))
        .when(source == SCROLL, F.lit("SCROLL"))
        .when(source == INPUT, F.lit("INPUT"))
        .when(source == MOUSE_MOVE, F.lit("MOUSE_MOVE"))
    )
    return (
        F.when(type_ == FULL_SNAPSHOT, F.lit("FULL_SNAPSHOT"))
        .when(type_ == META, F.lit("PAGE_META"))
        .when(type_ == INCREMENTAL, incremental)
        .when(type_ == PLUGIN, F.lit("API_CALL"))
    )


def _typed_kind(type_: Column, p: Column) -> Column:
    """The event type of a snapshot that becomes a typed event, else null."""
    kind = event_type(type_, p["source"], p["type"])
    has_text = F.length(F.coalesce(p["text"], F.lit(""))) > 0
    has_moves = F.coalesce(F.size(p["positions"]), F.lit(0)) > 0
    return F.when(((kind != "INPUT") | has_text) & ((kind != "MOUSE_MOVE") | has_moves), kind)


def classify_snapshot(fields: DataFrame) -> DataFrame:
    """Adds ``event_type`` and keeps only the rows that become typed events."""
    return fields.withColumn("event_type", _typed_kind(F.col("type"), F.col("p"))).filter(F.col("event_type").isNotNull())


def api_path(url: Column) -> Column:
    """Text after the last ``.app`` (the whole URL without one), query string included."""
    return F.element_at(F.split(url, r"\.app"), -1)


def api_calls(requests: Column) -> Column:
    """``[(path, full_path, method)]`` of the requests whose URL contains ``/api/``."""
    wanted = F.filter(requests, lambda r: F.coalesce(r["name"], F.lit("")).contains("/api/"))
    return F.transform(
        wanted,
        lambda r: F.struct(
            F.substring_index(api_path(r["name"]), "?", 1).alias("path"),
            F.substring(api_path(r["name"]), 1, 150).alias("full_path"),
            F.coalesce(r["method"], F.lit("unknown")).alias("method"),
        ),
    )


def _event_fields(kind: Column, p: Column, sub: Column, call: Column) -> list[Column]:
    """The columns of one typed event."""
    last_move = F.try_element_at(p["positions"], F.lit(-1))
    text, pointer = p["text"], kind.isin("CLICK", "INPUT")
    return [
        sub.cast("long").alias("sub"),
        kind.alias("event_type"),
        F.when(pointer, F.coalesce(p["id"], F.lit(0))).when(kind == "SCROLL", p["id"]).alias("node_id"),
        F.when(kind == "CLICK", p["x"]).when(kind == "MOUSE_MOVE", last_move["x"]).alias("x"),
        F.when(kind == "CLICK", p["y"]).when(kind == "MOUSE_MOVE", last_move["y"]).alias("y"),
        F.when(kind == "SCROLL", F.coalesce(p["x"], F.lit(0.0))).cast("long").alias("scroll_x"),
        F.when(kind == "SCROLL", F.coalesce(p["y"], F.lit(0.0))).cast("long").alias("scroll_y"),
        F.when(kind == "MOUSE_MOVE", F.size(p["positions"])).cast("long").alias("positions_count"),
        F.when(kind == "INPUT", F.length(text)).cast("long").alias("text_length"),
        F.when(kind == "INPUT", text.rlike(r"^\*+\z")).alias("is_masked"),
        F.when(kind == "PAGE_META", F.coalesce(p["href"], F.lit("")))
        .when(kind == "FULL_SNAPSHOT", F.lit("initial_page_load"))
        .alias("url"),
        F.when(kind == "PAGE_META", viewport_text(p["width"], p["height"])).alias("viewport"),
        call["path"].alias("path"),
        call["full_path"].alias("full_path"),
        call["method"].alias("method"),
    ]


def _calls(kind: Column, p: Column) -> Column:
    """The calls of a plugin snapshot, each an event of its own; one null for any other kind, none for no event."""
    nothing = F.array(F.lit(None).cast("struct<path: string, full_path: string, method: string>"))
    return F.when(kind == "API_CALL", api_calls(p["payload"]["requests"])).when(kind.isNotNull(), nothing)


def typed_events(fields: DataFrame) -> DataFrame:
    """The wide typed-event table; one plugin snapshot may yield several API_CALL rows."""
    p, kind = F.col("p"), F.col("event_type")
    rows = classify_snapshot(fields).select("session_id", "seq", "ts_ms", "event_type", "p", F.posexplode(_calls(kind, p)).alias("_sub", "_call"))
    columns = {c: x for c, x in zip(EVENT_COLUMNS, _event_fields(kind, p, F.col("_sub"), F.col("_call")))}
    return rows.select("session_id", "seq", columns["sub"], "ts_ms", *[x for c, x in columns.items() if c != "sub"])


EVENT_COLUMNS = ["sub", "event_type", "node_id", "x", "y", "scroll_x", "scroll_y", "positions_count", "text_length", "is_masked", "url", "viewport", "path", "full_path", "method"]


def viewport_text(width: Column, height: Column) -> Column:
    return F.concat(F.coalesce(width, F.lit("None")), F.lit("x"), F.coalesce(height, F.lit("None")))


def relative_time(snapshots: DataFrame) -> DataFrame:
    """Adds ``relative_s``: seconds since the first snapshot in file order (not the earliest one)."""
    firsts = Sequence(snapshots, ["session_id"], ["seq"])
    timed = firsts.first("_first_ms", F.col("ts_ms")).build()
    return timed.withColumn("relative_s", millis_to_seconds(F.col("ts_ms") - F.col("_first_ms"))).drop("_first_ms")


def session_spans(snapshots: DataFrame) -> DataFrame:
    """First and last snapshot time of each session, in file order."""
    return snapshots.groupBy("session_id").agg(
        F.min_by("ts_ms", "seq").alias("first_ms"), F.max_by("ts_ms", "seq").alias("last_ms")
    )


def session_header(snapshots: DataFrame, typed: DataFrame) -> DataFrame:
    """Duration (last minus first in file order) and number of typed events per session."""
    spans = session_spans(snapshots).select(
        "session_id", millis_to_seconds(F.col("last_ms") - F.col("first_ms")).alias("session_duration_s")
    )
    counts = typed.groupBy("session_id").agg(F.count(F.lit(1)).alias("total_raw_events"))
    return spans.join(counts, "session_id", "left").select(
        "session_id", "session_duration_s", F.coalesce("total_raw_events", F.lit(0)).alias("total_raw_events")
    )


def _loaded(text: str):
    """The JSON value of a root, or None for what is no JSON."""
    try:
        return json.loads(text)
    except ValueError:
        return None


def _plain(value) -> str:
    """Attribute values as text; booleans and numbers as JSON writes them."""
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def _walk(root_texts) -> list[dict]:
    """Node rows of one snapshot; a later visit of a node id replaces the earlier one.

    What is no object, or has no whole-number id, gives no row; its children are still visited.
    """
    nodes: dict[int, dict] = {}
    stack = [(_loaded(t), 0) for t in reversed(root_texts) if t]
    while stack:
        node, depth = stack.pop()
        if not isinstance(node, dict):
            continue
        children = node.get("childNodes")
        children = children if isinstance(children, list) else []
        if type(node.get("id")) is int and -(2**63) <= node["id"] < 2**63:
            attrs = node.get("attributes")
            attrs = attrs if isinstance(attrs, dict) else {}
            text = "".join(_plain(c.get("textContent")) for c in children if isinstance(c, dict) and c.get("type") == 3)
            nodes[node["id"]] = {
                "node_id": node["id"],
                "tag": _plain(node.get("tagName")),
                "class": _plain(attrs.get("class"))[:80],
                "href": _plain(attrs.get("href")),
                "type_attr": _plain(attrs.get("type")),
                "placeholder": _plain(attrs.get("placeholder")),
                "text": text.strip()[:100],
                "depth": depth,
            }
        stack.extend((c, depth + 1) for c in reversed(children))
    return list(nodes.values())


def _dom_nodes(roots: pd.Series) -> pd.Series:
    return roots.map(lambda texts: [] if texts is None else _walk(texts))


def flatten_dom(fields: DataFrame) -> DataFrame:
    """Element definitions: the tree of a full snapshot, or the nodes a mutation adds.

    A tree has no bounded depth, which built-in expressions cannot follow; the walk is an
    Arrow function over one snapshot at a time.
    """
    roots = _roots(F.col("type"), F.col("p"))
    return (
        fields.filter(roots.isNotNull())
        .select("session_id", "seq", F.explode(F.pandas_udf(_dom_nodes, NODE_TYPE)(roots)).alias("n"))
        .select("session_id", "seq", "n.*")
    )


def _roots(type_: Column, p: Column) -> Column:
    """JSON texts of the trees that a snapshot defines; null for one that defines none."""
    mutation = (type_ == INCREMENTAL) & (p["source"] == MUTATION)
    return F.when(type_ == FULL_SNAPSHOT, F.array(p["node"])).when(mutation, F.transform(p["adds"], lambda a: a["node"]))


class Parsed(NamedTuple):
    """What one pass over raw recordings leaves: stage tables of one write."""

    times: DataFrame
    """``session_id, seq, ts_ms`` of every snapshot."""
    events: DataFrame
    """Typed events, as ``typed_events`` gives them."""
    nodes: DataFrame
    """Element definitions, as ``flatten_dom`` gives them."""


def parsed_tables(recordings: DataFrame, part: str | None = None) -> Parsed:
    """Raw recordings -> their three tables, by one scan of the raw arrays and one parse of each payload.

    Each snapshot becomes its records (its time, its typed events, the definitions it holds), and they are written
    once, in a folder for each kind.  Rows are not shuffled.
    """
    snapshots = with_payload(explode_snapshots(recordings, part))
    p, kind = F.col("p"), F.col("_kind")
    rows = snapshots.withColumn("_kind", _typed_kind(F.col("type"), p)).withColumn("_nodes", F.pandas_udf(_dom_nodes, NODE_TYPE)(_roots(F.col("type"), p)))
    events = F.transform(F.coalesce(_calls(kind, p), F.array()), lambda call, i: F.struct(*_event_fields(kind, p, i, call)))
    event = F.transform(events, lambda e: F.struct(F.lit("event").alias("record"), e.alias("e"), F.lit(None).cast(_NODE).alias("n")))
    node = F.transform(F.coalesce("_nodes", F.array().cast(NODE_TYPE)), lambda n: F.struct(F.lit("node").alias("record"), F.lit(None).cast(_EVENT).alias("e"), n.alias("n")))
    time = F.array(F.struct(F.lit("time").alias("record"), F.lit(None).cast(_EVENT).alias("e"), F.lit(None).cast(_NODE).alias("n")))
    records = rows.select("session_id", "seq", "ts_ms", F.explode(F.concat(time, event, node)).alias("r")).select("session_id", "seq", "ts_ms", "r.*")
    tables = materialize_by(records, "record", ["time", "event", "node"])
    return Parsed(
        tables["time"].select("session_id", "seq", "ts_ms"),
        tables["event"].select("session_id", "seq", "e.sub", "ts_ms", *[f"e.{c}" for c in EVENT_COLUMNS if c != "sub"]),
        tables["node"].select("session_id", "seq", "n.*"),
    )


NODE_FIELDS = ["tag", "class", "href", "type_attr", "placeholder", "text"]


def resolve_node(events: DataFrame, definitions: DataFrame) -> DataFrame:
    """As-of join: the latest definition of the event's node in snapshot order.

    Definitions and references share one ordered union per ``(session, node)``; nothing is
    ever forgotten, and an unknown node gets the tag ``unknown``.
    """
    definition = F.struct(*[F.col(c) for c in NODE_FIELDS])
    defs = definitions.select("session_id", "seq", "node_id", definition.alias("_def"), F.lit(0).alias("_ref"))
    refs = events.withColumns({"_ref": F.lit(1), "node_id": F.coalesce("node_id", F.lit(0).cast("long"))})
    both = refs.unionByName(defs, allowMissingColumns=True)
    ordered = Sequence(both, ["session_id", "node_id"], ["seq", "_ref"])
    known = ordered.last_known("_node", F.col("_def")).build().filter(F.col("_ref") == 1)
    resolved = {
        c: F.coalesce(F.col("_node")[c], F.lit("unknown" if c == "tag" else "")) for c in NODE_FIELDS
    }
    return known.withColumns(resolved).drop("_node", "_def", "_ref")


def scroll_runs(typed: DataFrame) -> DataFrame:
    """Adds ``run``: scrolls between two non-scroll events share it; mouse moves break nothing."""
    visible = typed.filter(F.col("event_type") != "MOUSE_MOVE")
    breaks = F.when(F.col("event_type") != "SCROLL", F.lit(1)).otherwise(F.lit(0))
    ordered = Sequence(visible, ["session_id"], ["seq", "sub"])
    return ordered.running_sum("run", breaks).build()


def collapse_scrolls(typed: DataFrame) -> DataFrame:
    """Each maximal run of scrolls becomes one row."""
    at = F.struct("seq", "sub")
    runs = (
        scroll_runs(typed)
        .filter(F.col("event_type") == "SCROLL")
        .groupBy("session_id", "run")
        .agg(
            F.min("seq").alias("seq"),
            F.min_by("relative_s", at).alias("time"),
            F.max_by("relative_s", at).alias("_end"),
            F.min_by("scroll_y", at).alias("scroll_from"),
            F.max_by("scroll_y", at).alias("scroll_to"),
            F.max("scroll_y").alias("max_depth"),
        )
    )
    down = F.col("scroll_to") > F.col("scroll_from")
    return runs.select(
        "session_id",
        "seq",
        F.lit(0).cast("long").alias("sub"),
        "time",
        F.lit("SCROLL").alias("action"),
        "scroll_from",
        "scroll_to",
        "max_depth",
        seconds_between(F.col("time"), F.col("_end")).alias("duration_s"),
        F.when(down, F.lit("down")).otherwise(F.lit("up")).alias("direction"),
    )


def to_action_columns(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Projects onto the common action schema, filling absent fields with null."""
    present = set(df.columns)
    columns = [
        (F.col(c) if c in present else F.lit(None)).cast(t).alias(c)
        for c, t in ACTION_COLUMNS.items()
        if c not in ("session_id", "step")
    ]
    keep = [c for c in ("session_id", *(extra or []), "step") if c in present]
    return df.select(*keep, *columns)


def high_level_actions(direct: DataFrame, runs: DataFrame, stage: Callable = materialize) -> DataFrame:
    """Typed events with resolved nodes plus collapsed scroll runs -> the ordered action table."""
    kind = F.col("event_type")
    shaped = direct.filter(kind.isin("CLICK", "INPUT", "API_CALL", "PAGE_META")).withColumns(
        {
            "time": F.col("relative_s"),
            "action": F.when(kind == "INPUT", F.lit("TYPE")).when(kind == "PAGE_META", F.lit("PAGE_LOAD")).otherwise(kind),
            "target_tag": F.when(kind.isin("CLICK", "INPUT"), F.col("tag")),
            "target_text": F.when(kind == "CLICK", F.substring("text", 1, 50)),
            "target_href": F.when(kind == "CLICK", F.col("href")),
            "target_class": F.when(kind == "CLICK", F.substring("class", 1, 60)),
            "target_placeholder": F.when(kind == "INPUT", F.col("placeholder")),
            "url": F.when(kind == "PAGE_META", F.col("url")),
        }
    )
    place = ["seq", "sub"]
    both = stage(to_action_columns(shaped, place).unionByName(to_action_columns(runs, place)))
    numbered = Sequence(both, ["session_id"], place).number("step").build()
    return numbered.select("session_id", "step", *[c for c in ACTION_COLUMNS if c not in ("session_id", "step")])


def parse_recordings(
    recordings: DataFrame, part: str | None = None, stage: Callable = materialize
) -> tuple[DataFrame, DataFrame]:
    """Recordings -> (actions, session headers).

    The raw arrays are scanned once (``parsed_tables``); the ordered steps read narrow stage tables.
    """
    times, typed, nodes = parsed_tables(recordings, part)
    starts = session_spans(times).select("session_id", "first_ms")
    timed = typed.join(starts, "session_id").withColumn(
        "relative_s", millis_to_seconds(F.col("ts_ms") - F.col("first_ms"))
    )
    pointer = F.col("event_type").isin("CLICK", "INPUT")
    direct = resolve_node(timed.filter(pointer), nodes).unionByName(timed.filter(~pointer), allowMissingColumns=True)
    return high_level_actions(direct, collapse_scrolls(timed), stage), session_header(times, typed)


def user_profile(recordings: DataFrame, properties: str = "person.properties") -> DataFrame:
    """Demographic and device fields of the recorded person."""
    def prop(key: str) -> Column:
        return F.col(f"{properties}.`{key}`")

    return recordings.select(
        "session_id",
        *[prop(c).alias(c) for c in ("age_group", "country", "nyc_familiarity")],
        *[prop(f"${c}").alias(c) for c in ("os", "browser", "device_type", "viewport_width", "viewport_height",
                                           "screen_width", "screen_height")],
    )
