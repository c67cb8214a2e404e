"""Sliding-window (state -> next action) examples and their reproducible split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.exprs import fixed0, fixed1
from wayfold.operators.filters import NON_USER_ACTIONS
from wayfold.operators.sequence import with_lookback
from wayfold.session import materialize

WINDOW_SIZE = 5
MIN_SESSION_ACTIONS = 3
MIN_CLUSTER_EXAMPLES = 10
SPLIT_SEED = 42
SPLIT_BITS = 12
MOST_CUTOFFS = 100_000
"""Clusters whose cut-offs are broadcast; beyond them Spark chooses the join."""

SYSTEM_TEXT = (
    "You act in a browser the way one particular kind of visitor would. You receive a product description, "
    "a persona and the recent actions. Answer with a JSON object holding action (click, scroll, type, wait or "
    "navigate_back), target, reasoning and hesitation_ms."
)
"""Default instruction; callers pass their own wording."""


# Wording of the state text and of each kind's reasoning.
ASK, ASK_AFTER_ERROR = "What would you do next?", "Decide how to recover."
REASONING = {
    "CLICK": "Exploring {tag} element to interact with the product",
    "SCROLL": "Scrolling {direction} to {goal}",
    "TYPE": "Entering text to engage with the application",
    "API_CALL": "Waiting for the application to respond",
    "PAGE_LOAD": "Navigating to a new section of the product",
}
OTHER_REASONING = "Continuing to browse"
SCROLL_GOALS = {"down": "discover more content", "up": "review earlier content"}


def _fill(template: str, **parts: Column) -> Column:
    """The template with its named places filled by columns."""
    for name, value in parts.items():
        head, found, tail = template.partition("{" + name + "}")
        if found:
            return F.concat(F.lit(head), value, _fill(tail, **parts))
    return F.lit(template)


def _text(c: Column | str) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def hesitation(time: Column, previous: Column) -> Column:
    """Milliseconds since the previous action, truncated and never negative."""
    gap = F.when(previous.isNull(), time * F.lit(1000.0)).otherwise((time - previous) * F.lit(1000.0)).cast("long")
    return F.when(previous.isNull(), gap).otherwise(F.greatest(F.lit(0).cast("long"), gap))


def window_line(a: Column) -> Column:
    """One recent action as a line of the state text."""
    kind = a["action"]
    named = F.coalesce(F.nullif(_text(a["target_text"]), F.lit("")), _text(a["target_href"]))
    quoted = F.when(named != "", F.concat(F.lit(' "'), F.substring(named, 1, 50), F.lit('"'))).otherwise(F.lit(""))
    hint = _text(a["target_placeholder"])
    tail = (
        F.when(kind == "CLICK", F.concat(F.lit(" on "), F.coalesce(a["target_tag"], F.lit("?")), quoted))
        .when(kind == "SCROLL", F.concat(F.lit(" "), F.coalesce(a["direction"], F.lit("?")), F.lit(" to "),
                                         F.coalesce(a["scroll_to"], F.lit(0)).cast("string"), F.lit("px")))
        .when(kind == "TYPE", F.concat(F.lit(" "), F.coalesce(a["text_length"], F.lit(0)).cast("string"), F.lit(" chars into "),
                                       F.coalesce(a["target_tag"], F.lit("input")),
                                       F.when(hint != "", F.concat(F.lit(' ("'), hint, F.lit('")'))).otherwise(F.lit(""))))
        .when(kind == "API_CALL", F.concat(F.lit(" "), F.coalesce(a["path"], F.lit("?"))))
        .when(kind == "PAGE_LOAD", F.concat(F.lit(" "), F.coalesce(a["url"], F.lit("?"))))
        .otherwise(F.lit(""))
    )
    return F.concat(F.lit("  ["), fixed1(a["time"]), F.lit("s] "), kind, tail)


_LINE_FIELDS = ["action", "target_tag", "target_text", "target_href", "direction", "scroll_to", "text_length",
                "target_placeholder", "path", "url", "time"]


def _line() -> Column:
    return window_line(F.struct(*_LINE_FIELDS))


def with_recent(actions: DataFrame, size: int = WINDOW_SIZE, item: Column | None = None, name: str = "recent") -> DataFrame:
    """Adds the previous ``size`` actions (oldest first), the time of the previous one and the hesitation."""
    value = _line() if item is None else item

    def columns(w):
        return {
            name: F.collect_list(value).over(w.rowsBetween(-size, -1)),
            "elapsed": F.coalesce(F.lag("time").over(w), F.lit(0.0)),
            "hesitation_ms": hesitation(F.col("time"), F.lag("time").over(w)),
        }

    return with_lookback(actions, ["session_id"], "step", size, columns)


def product_context(name: str, url: str = "", description: str = "") -> str:
    """The product block that starts every state text."""
    lines = [f"Product: {name}"]
    if url:
        lines.append(f"URL: {url}")
    if description:
        lines.append(f"Features: {description}")
    return "\n".join(lines)


def state_text(context: str, duration: Column, error: Column | None = None) -> Column:
    """Context, position, recent actions and the closing question of the row's ``recent`` window."""
    head = F.concat(
        F.lit(context + "\n\nSession: step "), (F.col("step") - 1).cast("string"),
        F.lit(", elapsed "), fixed1(F.col("elapsed")), F.lit("s / "), fixed0(duration), F.lit("s"),
    )
    recent = F.when(F.size("recent") > 0, F.concat(F.lit("\n\nRecent actions:\n"), F.array_join("recent", "\n"))).otherwise(F.lit(""))
    asking = F.lit("\n\n" + ASK)
    if error is None:
        return F.concat(head, recent, asking)
    failed = F.concat(F.lit("\n\nLast action failed: "), error, F.lit("\n" + ASK_AFTER_ERROR))
    return F.concat(head, recent, F.when(_text(error) != "", failed).otherwise(asking))


def next_action() -> Column:
    """The action of the row as ``struct(action, target, reasoning)``."""
    kind = F.col("action")
    label = F.coalesce(F.nullif(_text("target_text"), F.lit("")), F.nullif(_text("target_href"), F.lit("")), _text("target_class"))
    tag = F.coalesce("target_tag", F.lit("element"))
    quoted = F.when(label != "", F.concat(F.lit(' "'), F.substring(label, 1, 60), F.lit('"'))).otherwise(F.lit(""))
    direction = F.coalesce("direction", F.lit("down"))
    goal = F.when(direction == "down", F.lit(SCROLL_GOALS["down"])).otherwise(F.lit(SCROLL_GOALS["up"]))
    back = F.lower(_text("url")).contains("back")
    action = (
        F.when(kind == "CLICK", F.lit("click")).when(kind == "SCROLL", F.lit("scroll")).when(kind == "TYPE", F.lit("type"))
        .when(kind == "API_CALL", F.lit("wait"))
        .when(kind == "PAGE_LOAD", F.when(back, F.lit("navigate_back")).otherwise(F.lit("click")))
        .otherwise(F.lower(kind))
    )
    target = (
        F.when(kind == "CLICK", F.concat(tag, quoted))
        .when(kind == "SCROLL", F.concat(direction, F.lit(" to "), F.coalesce("scroll_to", F.lit(0)).cast("string"), F.lit("px")))
        .when(kind == "TYPE", F.concat(F.coalesce("target_tag", F.lit("input")), F.lit(" ("), F.coalesce("target_placeholder", F.lit("text field")), F.lit(")")))
        .when(kind == "API_CALL", F.concat(F.lit("API response from "), F.coalesce("path", F.lit("/"))))
        .when(kind == "PAGE_LOAD", F.coalesce("url", F.lit("page")))
        .otherwise(F.lit("page"))
    )
    reasoning = None
    for name, template in REASONING.items():
        words = _fill(template, tag=tag, direction=direction, goal=goal)
        reasoning = F.when(kind == name, words) if reasoning is None else reasoning.when(kind == name, words)
    reasoning = reasoning.otherwise(F.lit(OTHER_REASONING))
    return F.struct(action.alias("action"), target.alias("target"), reasoning.alias("reasoning"))


def persona_text(clusters: DataFrame, base: str = SYSTEM_TEXT) -> DataFrame:
    """``(cluster_id, system)``: instruction, label, description, behaviours and averages of a cluster."""
    label = F.coalesce("label", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")))
    described = F.when(_text("description") != "", F.concat(F.lit("\n"), F.col("description"))).otherwise(F.lit(""))
    bullets = F.array_join(F.transform("key_behaviors", lambda b: F.concat(F.lit("- "), b)), "\n")
    listed = F.when(F.size("key_behaviors") > 0, F.concat(F.lit("\nKey behaviors:\n"), bullets)).otherwise(F.lit(""))
    averages = F.concat(F.lit("\nAvg session: "), fixed0(F.coalesce("avg_duration_s", F.lit(0.0))), F.lit("s, "),
                        fixed0(F.coalesce("avg_actions", F.lit(0.0))), F.lit(" actions"))
    return clusters.select(
        "cluster_id", F.concat(F.lit(base + '\n\nYour persona: "'), label, F.lit('"'), described, listed, averages).alias("system")
    )


def training_examples(
    actions: DataFrame,
    sessions: DataFrame,
    personas: DataFrame,
    context: str,
    size: int = WINDOW_SIZE,
) -> DataFrame:
    """One row per learnable action: ``(cluster_id, session_id, step, system, user, assistant)``.

    ``sessions`` holds ``session_id, cluster_id, session_duration_s, n_actions``; short sessions,
    the first action of a session and non-user actions give no example.
    """
    eligible = sessions.filter(F.col("n_actions") >= MIN_SESSION_ACTIONS)
    rows = (
        with_recent(actions, size)
        .filter((F.col("step") > 1) & ~F.col("action").isin(NON_USER_ACTIONS))
        .join(eligible.select("session_id", "cluster_id", "session_duration_s"), "session_id")
    )
    response = F.struct(next_action()["action"].alias("action"), next_action()["target"].alias("target"),
                        next_action()["reasoning"].alias("reasoning"), "hesitation_ms")
    return rows.select(
        "cluster_id", "session_id", "step",
        state_text(context, F.col("session_duration_s")).alias("user"),
        F.to_json(response).alias("assistant"),
    ).join(personas, "cluster_id")


def as_messages() -> Column:
    """The three chat messages of an example row."""
    return F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("content")) for r in ("system", "user", "assistant")])


def sequence_split(
    examples: DataFrame,
    cluster: str,
    ids: list[str],
    share: float = 0.1,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """Adds ``split``: per cluster, the ``max(1, int(n * share))`` rows smallest by seeded hash are ``val``.

    Only one number per cluster, the cut-off, has to be found: counts per hash prefix locate the
    bucket it lies in, and just that bucket is ranked.  The keys are a stage table, so examples are
    read for them and for the labels only.  The cut-offs are counted, and broadcast up to ``MOST_CUTOFFS``
    clusters: examples are then labelled where they are, whatever Spark's own limit for broadcasts.
    The sizes are exact, however large a cluster is.  ``ids`` identify an example.
    """
    place = F.struct(F.xxhash64(F.col(cluster) + F.lit(seed), *ids).alias("h"), *[F.col(c) for c in ids])
    bucket = F.shiftright("_at.h", 64 - SPLIT_BITS)
    keys = materialize(examples.select(F.col(cluster).alias("_c"), place.alias("_at")).withColumn("_bucket", bucket))
    per_bucket = keys.groupBy("_c", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_c")
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.greatest(F.lit(1).cast("long"), (F.sum("_n").over(whole) * F.lit(share)).cast("long"))
    edges = (
        per_bucket.withColumns({"_quota": quota, "_before": F.coalesce(F.sum("_n").over(before), F.lit(0))})
        .filter((F.col("_before") < F.col("_quota")) & (F.col("_quota") <= F.col("_before") + F.col("_n")))
        .select("_c", "_bucket", (F.col("_quota") - F.col("_before")).alias("_rank"))
    )
    ranked = keys.join(edges, ["_c", "_bucket"]).withColumn("_no", F.row_number().over(whole.orderBy("_at")))
    cutoffs = materialize(ranked.filter(F.col("_no") == F.col("_rank")).select("_c", F.col("_at").alias("_last")))
    if cutoffs.count() <= MOST_CUTOFFS:
        cutoffs = F.broadcast(cutoffs)
    joined = examples.join(cutoffs, F.col(cluster) == F.col("_c"))
    return joined.withColumn("split", F.when(place <= F.col("_last"), F.lit("val")).otherwise(F.lit("train"))).drop("_c", "_last")


def training_counts(examples: DataFrame) -> DataFrame:
    """Examples per cluster and split, with per-cluster and grand totals (null = all)."""
    return examples.rollup("cluster_id", "split").agg(F.count(F.lit(1)).alias("examples"))
