"""Flat-event sessions: the second input format, normalised to the same action table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.exprs import fixed0, rounded
from wayfold.operators.sequence import Sequence
from wayfold.operators.snapshots import to_action_columns

# Suffixes that mark the pointer events folded into CLICK.
RAGE, DEAD = " [RAGE CLICK]", " [DEAD CLICK]"
UNNAMED_AGENTS = ["imported", "synthetic", ""]


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def normalize_flat_event(events: DataFrame, order: list[str]) -> DataFrame:
    """Flat events -> actions.  ``order`` gives file order; ``step`` numbers the kept rows."""
    kind = F.col("event_type")
    scroll_y = F.when(kind == "scroll", F.coalesce("scroll_y", F.lit(0.0)))
    ordered = Sequence(events, ["session_id"], order)
    kept = F.when(_action(kind).isNotNull(), F.lit(1)).otherwise(F.lit(0))
    rows = (
        ordered.first("_t0", F.col("timestamp"))
        .last_known("_last_y", scroll_y, inclusive=False)
        .running_sum("step", kept)
        .build()
        .withColumns({"_last_y": F.coalesce("_last_y", F.lit(0.0)), "_y": scroll_y, "action": _action(kind)})
        .filter(F.col("action").isNotNull())
    )
    clicks = kind.isin("click", "rage_click", "dead_click")
    hover_ms = fixed0(F.coalesce("hover_duration_ms", F.lit(0.0)))
    pointer = clicks | (kind == "hover")
    target_text = (
        F.when(kind == "click", _text("target_text"))
        .when(kind == "rage_click", F.trim(F.concat(_text("target_text"), F.lit(RAGE))))
        .when(kind == "dead_click", F.trim(F.concat(_text("target_text"), F.lit(DEAD))))
        .when(kind == "hover", F.concat(_text("target_text"), F.lit(" [HOVER "), hover_ms, F.lit("ms]")))
        .when(kind == "hesitation", F.concat(F.lit("[HESITATION "), hover_ms, F.lit("ms]")))
    )
    is_click, is_scroll, is_type, is_load = (F.col("action") == a for a in ("CLICK", "SCROLL", "TYPE", "PAGE_LOAD"))

    def point(c: str) -> Column:
        return F.when(pointer, F.coalesce(F.col(c), F.lit(0.0)).cast("long")).when(is_click, F.lit(0)).cast("double")

    shaped = rows.withColumns(
        {
            "time": rounded((F.col("timestamp") - F.col("_t0")) / F.lit(1000.0), 2),
            "target_tag": F.when(kind == "hesitation", F.lit("page"))
            .when(is_click, _text("target_tag"))
            .when(is_type, F.coalesce("target_tag", F.lit("input"))),
            "target_text": target_text,
            "target_href": F.when(is_click, F.lit("")),
            "target_class": F.when(pointer, F.ltrim(_text("target_selector"), F.lit("."))).when(is_click, F.lit("")),
            "x": point("x"),
            "y": point("y"),
            "scroll_from": F.when(is_scroll, F.col("_last_y").cast("long")),
            "scroll_to": F.when(is_scroll, F.col("_y").cast("long")),
            "max_depth": F.when(is_scroll, F.greatest("_y", "_last_y").cast("long")),
            "duration_s": F.when(is_scroll, F.lit(0.5)),
            "direction": F.when(is_scroll, F.when(F.col("_y") >= F.col("_last_y"), F.lit("down")).otherwise(F.lit("up"))),
            "text_length": F.when(is_type, F.coalesce("text_length", F.length(_text("text")).cast("long"))),
            "is_masked": F.when(is_type, F.coalesce("is_masked", F.lit(False))),
            "target_placeholder": F.when(is_type, _text("placeholder")),
            "url": F.when(is_load, _text("url")),
            "viewport": F.when(is_load, F.concat(_size("viewport_width"), F.lit("x"), _size("viewport_height"))),
        }
    )
    return to_action_columns(shaped.withColumn("step", F.col("step").cast("long")))


def _action(kind: Column) -> Column:
    return (
        F.when(kind == "page_load", F.lit("PAGE_LOAD"))
        .when(kind.isin("click", "rage_click", "dead_click", "hover", "hesitation"), F.lit("CLICK"))
        .when(kind == "scroll", F.lit("SCROLL"))
        .when(kind.isin("input", "type"), F.lit("TYPE"))
    )


def _size(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit(0.0)).cast("string"), F.lit("0"))


def flat_profile(sessions: DataFrame) -> DataFrame:
    """Profile of a flat session: defaults for what the format does not record.

    ``event_count`` 0 means an empty session, which keeps only its id and duration.
    """
    empty = F.col("event_count") == 0

    def filled(c: Column) -> Column:
        return F.when(~empty, c)

    width = F.coalesce("viewport_width", F.lit(1920.0))
    height = F.coalesce("viewport_height", F.lit(1080.0))
    agent = F.coalesce("user_agent", F.lit(""))
    return sessions.select(
        "session_id",
        filled(F.coalesce("age_group", F.lit("unknown"))).alias("age_group"),
        filled(F.coalesce("country", F.lit("unknown"))).alias("country"),
        filled(F.lit("unknown")).alias("nyc_familiarity"),
        filled(F.lit("unknown")).alias("os"),
        filled(F.when(agent.isin(UNNAMED_AGENTS), F.lit("unknown")).otherwise(agent)).alias("browser"),
        filled(F.coalesce("device_type", F.lit("desktop"))).alias("device_type"),
        filled(width).alias("viewport_width"),
        filled(height).alias("viewport_height"),
        filled(width).alias("screen_width"),
        filled(height).alias("screen_height"),
        rounded(F.coalesce("duration_ms", F.lit(0.0)) / F.lit(1000.0), 1).alias("session_duration_s"),
        F.col("event_count").cast("long").alias("total_raw_events"),
    )


def union_inputs(*actions: DataFrame) -> DataFrame:
    """Both input formats as one action table."""
    whole = actions[0]
    for more in actions[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    return whole
