"""Ordered per-key computation that never needs a whole key in one task.

A plain ``Window.partitionBy(session).orderBy(ts)`` sends every row of a session to
one task; one session that holds a third of all rows then stalls the job.  Here only such
keys are cut, at values of their own order columns, wherever the rows lie densely:

1. one aggregation takes a uniform sample of bounded size (the least hash of each of
   ``SLOTS`` slots) and the row count; keys that hold more than a segment's rows get cut points,
2. the cut points are broadcast (never more than ``SLOTS`` values); a row's segment is the number
   of its key's cut points up to it, 0 for all other keys,
3. rows are windowed inside ``(key, segment)``: the only shuffle of the rows,
4. segments of cut keys are reduced, map-side first, to one summary row each; the summaries are
   scanned in order, and what a segment inherits is broadcast back, bounded like the cut points.

A segment holds about ``max(LEAST_ROWS, rows / SEGMENTS)`` rows, however sparse or dense a key
is; rows that are equal in all order columns share one.  The source is read for rows, sample
(keys and order only) and, if any key is cut, those keys' summaries: hand in a stage table
where its rows are costly to compute.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENTS = 512
"""Segments that a table is cut into at most; more give smaller windows and larger broadcasts."""

LEAST_ROWS = 50_000
"""Rows below which a key is never cut."""

SLOTS_PER_SEGMENT = 8
"""Sampled rows for each segment."""

PAGE_ROWS = 10_000
"""Rows gathered at most into one list, text or recording part."""


def cut_points(df: DataFrame, keys: list[str], order: list[str], segments: int | None = None, least_rows: int | None = None) -> DataFrame:
    """``_k, _cuts``: for each key with several segments' rows, the order values at which it is cut.

    Nulls of order columns sort first, as they do in the windows.
    """
    segments, least_rows = segments or SEGMENTS, least_rows or LEAST_ROWS
    slots = segments * SLOTS_PER_SEGMENT
    rows = df.select(F.struct(*keys).alias("_k"), F.struct(*order).alias("_o"), F.xxhash64(*keys, *order).alias("_h"))
    sample = rows.groupBy(F.pmod("_h", F.lit(slots))).agg(F.min(F.struct("_h", "_k", "_o")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy()  # at most ``slots`` rows
    share = F.count(F.lit(1)).over(everything) / F.sum("_n").over(everything)
    wanted = F.greatest(F.lit(least_rows), F.sum("_n").over(everything) / F.lit(segments))
    sample = sample.select("_s._k", "_s._o", F.greatest(F.lit(1), F.ceil(share * wanted)).cast("int").alias("_step"))
    by_key = sample.groupBy("_k").agg(F.array_sort(F.collect_list("_o")).alias("_os"), F.max("_step").alias("_step"))
    places = F.sequence(F.col("_step"), F.size("_os") - 1, F.col("_step"))
    return by_key.filter(F.size("_os") >= 2 * F.col("_step")).select("_k", F.transform(places, lambda i: F.get("_os", i)).alias("_cuts"))


class Sequence:
    """Collects ordered columns over one ``(keys, order)`` and computes them together.

    ``keys`` identify a session (or another entity); nulls of a key are a key.  ``order`` should name
    a row nearly uniquely.  A single ordering column is a position and never null; with several, nulls
    sort first.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], segments: int | None = None, least_rows: int | None = None):
        self._keys = keys
        self._seg = "_segment"
        self._df = df
        self._names = order
        self._size = (segments, least_rows)
        self._order = [F.col(c) for c in order]
        # One plain ordering column keeps the summaries in hash aggregation; several need a struct.
        self._rank = self._order[0] if len(order) == 1 else F.struct(*self._order)
        local = Window.partitionBy(*keys, self._seg).orderBy(*self._order)
        start, now = Window.unboundedPreceding, Window.currentRow
        self._row = local
        self._upto = local.rowsBetween(start, now)
        self._before = local.rowsBetween(start, -1)
        self._all = Window.partitionBy(*keys, self._seg)
        per_key = Window.partitionBy("_k").orderBy(self._seg)
        self._seg_order = per_key
        self._seg_before = per_key.rowsBetween(start, -1)
        self._seg_all = Window.partitionBy("_k")
        self._local: dict[str, Column] = {}
        self._summary: dict[str, Column] = {}
        self._carry: dict[str, Column] = {}
        self._final: dict[str, Column] = {}

    def number(self, name: str = "step") -> "Sequence":
        """1-based position of the row within its key."""
        self._local[f"_l_{name}"] = F.row_number().over(self._row).cast("long")
        self._summary[f"_s_{name}"] = F.count(F.lit(1))
        self._carry[f"_c_{name}"] = F.sum(f"_s_{name}").over(self._seg_before)
        self._final[name] = F.col(f"_l_{name}") + F.coalesce(f"_c_{name}", F.lit(0))
        return self

    def running_sum(self, name: str, value: Column, inclusive: bool = True) -> "Sequence":
        frame = self._upto if inclusive else self._before
        self._local[f"_l_{name}"] = F.coalesce(F.sum(value).over(frame), F.lit(0))
        self._summary[f"_s_{name}"] = F.coalesce(F.sum(value), F.lit(0))
        self._carry[f"_c_{name}"] = F.sum(f"_s_{name}").over(self._seg_before)
        self._final[name] = F.col(f"_l_{name}") + F.coalesce(f"_c_{name}", F.lit(0))
        return self

    def last_known(self, name: str, value: Column, inclusive: bool = True) -> "Sequence":
        """Latest non-null value up to (or strictly before) the row."""
        frame = self._upto if inclusive else self._before
        self._local[f"_l_{name}"] = F.last(value, ignorenulls=True).over(frame)
        self._summary[f"_s_{name}"] = F.max_by(value, F.when(value.isNotNull(), self._rank))
        self._carry[f"_c_{name}"] = F.last(f"_s_{name}", ignorenulls=True).over(self._seg_before)
        self._final[name] = F.coalesce(F.col(f"_l_{name}"), F.col(f"_c_{name}"))
        return self

    def previous(self, name: str, value: Column) -> "Sequence":
        """Value of the row just before, whatever it is; null for the first row."""
        # Boxed, so that a null value of the row before differs from having no row before.
        self._local[f"_l_{name}"] = F.lag(F.struct(value.alias("v"))).over(self._row)
        self._summary[f"_s_{name}"] = F.max_by(value, self._rank)
        self._carry[f"_c_{name}"] = F.lag(f"_s_{name}").over(self._seg_order)
        boxed = F.col(f"_l_{name}")
        self._final[name] = F.when(boxed.isNotNull(), boxed["v"]).otherwise(F.col(f"_c_{name}"))
        return self

    def first(self, name: str, value: Column) -> "Sequence":
        """Value of the first row of the key, on every row."""
        self._local[f"_l_{name}"] = F.first(value).over(self._upto)
        return self._whole(name, F.min_by(value, self._rank), F.min_by(f"_s_{name}", self._seg))

    def last(self, name: str, value: Column) -> "Sequence":
        """Value of the last row of the key, on every row."""
        agg = F.max_by(value, self._rank)
        self._local[f"_l_{name}"] = agg.over(self._all)
        return self._whole(name, agg, F.max_by(f"_s_{name}", self._seg))

    def total(self, name: str, agg: Column, merge: Callable) -> "Sequence":
        """A mergeable aggregate of the whole key, on every row."""
        self._local[f"_l_{name}"] = agg.over(self._all)
        return self._whole(name, agg, merge(F.col(f"_s_{name}")))

    def _whole(self, name: str, agg: Column, merged: Column) -> "Sequence":
        self._summary[f"_s_{name}"] = agg
        self._carry[f"_c_{name}"] = merged.over(self._seg_all)
        self._final[name] = F.when(F.col("_g").isNull(), F.col(f"_l_{name}")).otherwise(F.col(f"_c_{name}"))
        return self

    def _cut(self, cuts: DataFrame, how: str) -> DataFrame:
        """Rows with their segment, and with ``_g`` (key and segment) where their key is cut."""
        rows = self._df.join(F.broadcast(cuts), F.struct(*[self._df[k] for k in self._keys]) == cuts["_k"], how)
        here = F.struct(*self._order)
        segment = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= here)))
        return rows.withColumn(self._seg, segment).withColumn("_g", F.when(F.col("_k").isNotNull(), F.struct("_k", self._seg))).drop("_cuts")

    def build(self) -> DataFrame:
        cuts = cut_points(self._df, self._keys, self._names, *self._size)
        rows = self._cut(cuts, "left").drop("_k").withColumns(self._local)
        summary = self._cut(cuts, "inner").groupBy("_k", self._seg).agg(*[c.alias(n) for n, c in self._summary.items()])
        carried = summary.select(F.struct("_k", self._seg).alias("_at"), *[c.alias(n) for n, c in self._carry.items()])
        joined = rows.join(F.broadcast(carried), F.col("_g") == F.col("_at"), "left")
        return joined.withColumns(self._final).drop(*self._local, *self._carry, self._seg, "_g", "_at")


def with_lookback(
    df: DataFrame,
    keys: list[str],
    step: str,
    lookback: int,
    columns: Callable,
    page_rows: int | None = None,
) -> DataFrame:
    """Columns that look back at most ``lookback`` rows of a dense 1-based ``step``.

    Each page of ``page_rows`` steps is a window partition of its own; the last
    ``lookback`` rows of a page are copied into the next one so that no row misses its
    predecessors.  ``columns(window)`` returns the columns to add.
    """
    page_rows = page_rows or PAGE_ROWS
    if page_rows < lookback:
        raise ValueError("page_rows must be at least lookback")
    position = F.col(step) - 1
    home = F.floor(position / F.lit(page_rows)).cast("long")
    near_end = F.pmod(position, F.lit(page_rows)) >= page_rows - lookback
    spread = df.withColumn("_home", home).withColumn(
        "_page", F.explode(F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home")))
    )
    window = Window.partitionBy(*keys, "_page").orderBy(step)
    return spread.withColumns(columns(window)).filter(F.col("_page") == F.col("_home")).drop("_home", "_page")


def paged(
    df: DataFrame,
    keys: list[str],
    step: str,
    value: Column,
    name: str,
    page_rows: int | None = None,
) -> DataFrame:
    """Ordered lists of bounded length: one row per key and page of ``page_rows`` steps."""
    page_rows = page_rows or PAGE_ROWS
    return (
        df.select(*keys, F.floor((F.col(step) - 1) / F.lit(page_rows)).cast("long").alias("page"),
                  F.struct(F.col(step).alias("s"), value.alias("v")).alias("_item"))
        .groupBy(*keys, "page")
        .agg(F.transform(F.array_sort(F.collect_list("_item")), lambda i: i["v"]).alias(name))
    )


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark limits each group on the map side before shuffling."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("long")).filter(F.col(rank) <= k)
