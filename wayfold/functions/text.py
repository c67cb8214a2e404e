"""Text, JSON and log-line expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.exprs import plain_seconds

# The action taken when a model's answer cannot be read.
FALLBACK = {"action": "scroll", "target": "down 300px", "reasoning": "fallback — unparseable output", "hesitation_ms": 500}
MAX_SCROLL_PX, DEFAULT_SCROLL_PX, DEFAULT_EXPLORE_PX = 2000, 300, 400
ACTION_ANSWER = "action STRING, target STRING, reasoning STRING, hesitation_ms BIGINT"


def is_json(text: Column) -> Column:
    """Whether the text is exactly one JSON value; the lenient parsers ignore what follows it."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))


def json_object(text: Column) -> Column:
    """The text itself when it is one whole JSON object, else null."""
    whole = F.trim(text, F.lit(" \n\r\t"))
    return F.when(whole.startswith("{") & whole.endswith("}") & is_json(whole), whole)


def parse_action_json(text: Column) -> Column:
    """``struct(action, target, reasoning, hesitation_ms)`` of a model answer.

    The whole text, else its first brace group without inner braces, else the fallback.
    """
    braces = F.regexp_extract(text, r"\{[^{}]*\}", 0)
    fallback = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in FALLBACK.items()]))
    return F.from_json(F.coalesce(json_object(text), json_object(braces), fallback), ACTION_ANSWER)


def parse_scroll_target(target: Column) -> Column:
    """Signed scroll distance: up if mentioned, first number capped, 300 by default."""
    digits = F.regexp_extract(target, r"(\d+)", 1)
    pixels = F.when(digits == "", F.lit(DEFAULT_SCROLL_PX)).otherwise(
        F.least(F.coalesce(digits.try_cast("bigint"), F.lit(MAX_SCROLL_PX)), F.lit(MAX_SCROLL_PX))
    )
    return F.when(F.lower(target).contains("up"), -pixels).otherwise(pixels).cast("long")


def parse_explore_scroll(target: Column) -> Column:
    """The exploring agent's variant: down only if mentioned, the number needs ``px``, 400 by default, no cap."""
    digits = F.regexp_extract(target, r"(\d+)px", 1)
    pixels = F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(DEFAULT_EXPLORE_PX))
    return F.when(F.lower(target).contains("down"), pixels).otherwise(-pixels).cast("long")


def split_type_target(target: Column) -> Column:
    """``field: text`` at the first colon -> ``struct(field, text)``; quotes around the field go, text is null without a colon."""
    clean = _strip(target)
    at = F.instr(clean, ":")
    field = F.when(at > 0, F.substring_index(clean, ":", 1)).otherwise(clean)
    text = F.when(at > 0, _strip(F.substring(clean, at + 1, F.length(clean))))
    return F.struct(_strip(F.btrim(_strip(field), F.lit("\"' "))).alias("field"), text.alias("text"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def extract_id(body: Column) -> Column:
    """Recording id of a webhook payload; an empty value counts as missing."""
    def at(path: str) -> Column:
        return F.nullif(F.get_json_object(body, path), F.lit(""))

    return F.coalesce(
        at("$.properties['$session_recording_id']"), at("$.properties['$session_id']"), at("$.properties.session_id"), at("$.data.session_id")
    )


def action_log_line() -> Column:
    """The row's action as a line of the session log; null for kinds the log leaves out.

    Fixed values: the wording of the five kinds of line is the log's format.
    """
    kind = F.col("action")

    def text(c: str) -> Column:
        return F.coalesce(c, F.lit(""))

    def whole(c: str) -> Column:
        return F.col(c).cast("long").cast("string")

    stamp = F.concat(F.lit("["), plain_seconds(F.col("time")), F.lit("s] "))
    link = F.when(text("target_href") != "", F.concat(F.lit(" (link to: "), "target_href", F.lit(")"))).otherwise(F.lit(""))
    shown = F.when(text("target_text") != "", F.concat(F.lit(' text="'), "target_text", F.lit('"'))).otherwise(F.lit(""))
    hint = F.when(text("target_placeholder") != "", F.concat(F.lit(' (placeholder: "'), "target_placeholder", F.lit('")'))).otherwise(F.lit(""))
    return (
        F.when(kind == "CLICK", F.concat(stamp, F.lit("Clicked "), text("target_tag"), link, shown,
                                         F.lit(" at ("), F.coalesce(whole("x"), F.lit("None")), F.lit(", "), F.coalesce(whole("y"), F.lit("None")), F.lit(")")))
        .when(kind == "SCROLL", F.concat(stamp, F.lit("Scrolled "), "direction", F.lit(" from "), whole("scroll_from"), F.lit("px to "), whole("scroll_to"),
                                         F.lit("px (max depth: "), whole("max_depth"), F.lit("px) over "), plain_seconds(F.col("duration_s")), F.lit("s")))
        .when(kind == "TYPE", F.concat(stamp, F.lit("Typed "), whole("text_length"), F.lit(" characters into "), text("target_tag"), hint))
        .when(kind == "API_CALL", F.concat(stamp, F.lit("API: "), text("full_path")))
        .when(kind == "PAGE_LOAD", F.concat(stamp, F.lit("Page loaded: "), text("url"), F.lit(" ("), text("viewport"), F.lit(")")))
    )


def classify_log_line(line: Column) -> Column:
    """Kind of a pipeline output line; blank lines have none."""
    return (
        F.when(_strip(line) == "", F.lit(None))
        .when(line.contains("ERROR:") | line.contains("Error:"), F.lit("error"))
        .when(line.contains("WARNING:") | line.contains("Warning:"), F.lit("warning"))
        .when(line.rlike(r"^\s*\d+/\d+") | line.contains("..."), F.lit("progress"))
        .when(line.startswith("===") | line.startswith("---"), F.lit("section"))
        .otherwise(F.lit("log"))
    )


# Numbered headings of a feedback text, in order.
SECTIONS = ["Friction Points", "Accessibility Issues", "Flow Problems", "Performance Concerns", "Specific Recommendations"]
TAKEAWAY = "Key Takeaway"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _opened(line: Column, at: Column) -> Column:
    """``(at, key, rest)`` of a line: which section it opens, 0 for a numbered heading of another title, null for none.

    A heading has two hash marks or more; asterisks, case and repeated blanks do not matter.
    """
    def titled(h: Column) -> Column:
        number, name = h["number"], h["name"]
        key, rest = F.when(number.between(1, len(SECTIONS)), F.lit(0)), F.lit("")
        for place, title in enumerate([*SECTIONS, TAKEAWAY], start=1):
            meant = F.lower(name).startswith(title.lower()) & (number.isNull() if title == TAKEAWAY else number == place)
            key, rest = F.when(meant, F.lit(place)).otherwise(key), F.when(meant, F.substring(name, len(title) + 1, F.length(name))).otherwise(rest)
        return F.struct(at.alias("at"), key.alias("key"), rest.alias("rest"))

    def parted(head: Column) -> Column:
        number = F.substring_index(head, ".", 1).try_cast("int")
        name = F.when(number.isNotNull(), F.ltrim(F.substring(head, F.instr(head, ".") + 1, F.length(head)))).otherwise(head)
        return _let(F.struct(number.alias("number"), name.alias("name")), titled)

    bare = F.translate(line, "*", "")
    return F.when(F.ltrim(bare).startswith("##"), _let(F.trim(F.regexp_replace(F.regexp_extract(bare, r"^\s*##+(.*)", 1), r"\s+", " ")), parted))


def markdown_sections(text: Column) -> dict[str, Column]:
    """Body of each numbered section and of the takeaway, trimmed; null where the heading is missing.

    The text is cut at its headings.  What follows a title on its line belongs to the body, but for the
    recommendations, whose title may have an addition.
    """
    lines = F.split(text, "\n")
    read = F.struct(lines.alias("lines"), F.filter(F.transform(lines, _opened), lambda h: h["key"].isNotNull()).alias("heads"))

    def body(place: int, title: str) -> Column:
        def cut(r: Column) -> Column:
            def between(s: Column) -> Column:
                under = F.array_join(F.slice(r["lines"], s["own"]["at"] + 2, s["end"] - s["own"]["at"] - 1), "\n")
                return _strip(under if title == SECTIONS[-1] else F.concat(s["own"]["rest"], F.lit("\n"), under))

            def ended(own: Column) -> Column:
                after = F.get(F.filter(r["heads"], lambda h: h["at"] > own["at"]), F.lit(0))["at"]
                return F.when(own.isNotNull(), _let(F.struct(own.alias("own"), F.coalesce(after, F.size(r["lines"])).alias("end")), between))

            return _let(F.get(F.filter(r["heads"], lambda h: h["key"] == place), F.lit(0)), ended)

        return _let(read, cut)

    return {title: body(place, title) for place, title in enumerate([*SECTIONS, TAKEAWAY], start=1)}
