"""Mixing sources to target weights by capped water-filling.

``targets`` raises one water level over all sources: a source's target is its weight times the level, but at
most ``max_epochs`` times its size; what a full source cannot take flows to the others by weight.  ``mix`` then
takes every document of a source the same whole number of times and, in seeded hash order, as many words of one
further repetition as the target still asks for, so that a source's taken words differ from its target by
less than one word.  ``copies`` turns the plan into rows.

Only DataFrame functions are used.  No source is ever sorted as a whole: the cut of the last repetition is found
from sums per hash bucket, and only the one bucket that the cut falls into is ordered.  Rows alike in id and size
are summed before anything is shuffled by source, so a repeated document is no hot key either.

Defined results: null text has size 0; a null source is a source and comes last; a null id hashes like the word
``null``; rows alike in id and text take the repetition as one run, counted off in turn; an empty table gives
an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import SPACES, WORD, fresh, n_words, null_safe, seeded_hash, seeded_hash_sql

SEED = 20
#: Hash buckets of one source; the bucket of the cut is the only part of a source that gets ordered.
BUCKETS = 4096
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` (one row a source) with ``target``.

    Sources in code point order, null last, get the weights in turn.  The share they must fill is
    ``total_share`` of all sizes (all they can give, if that is less).  Sorted by the level at which they are
    full, the sources that stay full are a prefix of that order, so the level follows from running sums: it is
    the fixed point of clamping the sources above their limit and sharing the excess again by weight.  The
    table has one row a source; it is the only one that is ordered as a whole.
    """
    listed = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(listed) - 1) % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    rising = Window.orderBy("_full_at", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    table = sizes.select("source", "source_size", weight.alias("_weight")).withColumn("_limit", F.lit(float(max_epochs)) * F.col("source_size"))
    table = table.withColumn("_full_at", F.col("_limit") / F.col("_weight"))
    table = table.withColumn("_share", F.least(F.lit(float(total_share)) * F.sum("source_size").over(whole), F.sum("_limit").over(whole)))
    left = F.col("_share") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    open_weight = F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    table = table.withColumn("_level", left / open_weight).withColumn("_open", F.col("_full_at") >= F.col("_level"))
    level = F.min(F.when(F.col("_open"), F.struct("_full_at", "_level"))).over(whole)["_level"]
    return table.withColumn("_level", level).select(
        "source", "source_size", F.when(F.col("_level").isNull() | (F.col("_full_at") <= F.col("_level")), F.col("_limit")).otherwise(F.col("_weight") * F.col("_level")).alias("target")
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, source, size, text_md5, n_rows, source_size, target, whole, extra``: one row a different document.

    ``n_rows`` rows of the input are alike in id, source and text.  Each is taken ``whole`` times; together they
    give ``extra`` more words, the first of them up to their size first.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    alike = sized.groupBy("doc_id", "source", "size", "text_md5").agg(F.count(F.lit(1)).alias("n_rows"))
    alike = alike.withColumn("_hash", seeded_hash(seed, F.col("doc_id"), F.col("text_md5"))).withColumn("_bucket", F.col("_hash") % buckets)
    sums = alike.groupBy("source", "_bucket").agg(F.sum(F.col("size") * F.col("n_rows")).alias("_bucket_size"))
    goal = targets(sums.groupBy("source").agg(F.sum("_bucket_size").alias("source_size")), weights, total_share, max_epochs)
    goal = goal.withColumn("_words", F.floor(F.col("target") + 0.5).cast("long"))
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("_words") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("_rest", F.col("_words") - F.col("whole") * F.col("source_size")).drop("_words")
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_bucket_size").over(upto), F.lit(0)))
    plan = goal.withColumnRenamed("source", "_source")
    starts = starts.join(plan, starts["source"].eqNullSafe(plan["_source"])).drop("_source")
    starts = starts.withColumn("_free", F.col("_rest") - F.col("_before"))
    cut = (F.col("_free") > 0) & (F.col("_free") < F.col("_bucket_size"))
    starts = starts.select(F.col("source").alias("_source"), F.col("_bucket").alias("_of"), "source_size", "target", "whole", "_free", cut.alias("_cut"))
    rows = alike.join(starts, alike["source"].eqNullSafe(starts["_source"]) & (alike["_bucket"] == starts["_of"])).drop("_source", "_of")
    full = F.col("size") * F.col("n_rows")
    kept = ["doc_id", "source", "size", "text_md5", "n_rows", "source_size", "target", "whole"]
    sure = rows.filter(~F.col("_cut")).select(*kept, F.when(F.col("_free") > 0, full).otherwise(0).alias("extra"))
    ordered = Window.partitionBy("source", "_bucket").orderBy("_hash", "doc_id", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.greatest(F.lit(0), F.least(full, F.col("_free") - F.coalesce(F.sum(full).over(ordered), F.lit(0))))
    return sure.unionByName(rows.filter("_cut").select(*kept, taken.alias("extra")))


def _one_by_one(plan: DataFrame) -> DataFrame:
    """The plan with one row for each input row: ``taken`` words of each, alike rows filled in turn."""
    each = plan.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("_turn") * F.col("size")))
    return each.withColumn("taken", (F.col("whole") * F.col("size") + part).cast("long"))


def mixed_words(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``."""
    return _one_by_one(mix(docs, **how)).select("doc_id", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[{SPACES}]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def copies(docs: DataFrame, **how) -> DataFrame:
    """The mix as rows with the columns of ``docs``: whole copies, and one cut copy where a repetition ends.

    A cut copy holds the first words of the text and has its own ``n_chars`` where that column exists.
    Documents without words are kept once: they weigh nothing in any mix.
    """
    md5, turn, take, size = (fresh(x, docs.columns) for x in ("_md5", "_turn", "_take", "_size"))
    plan = mix(docs, **how).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_md5").alias("_digest"), F.col("size").alias(size), "whole", "n_rows", (F.col("extra") / F.col("n_rows")).alias("_even"), "extra"
    )
    rows = docs.withColumn(md5, F.md5(F.coalesce("text", F.lit(""))))
    plan = plan.select("_id", "_source", "_digest", F.struct(size, "whole", "n_rows", "extra").alias(take))
    joined = rows.join(plan, rows["doc_id"].eqNullSafe(plan["_id"]) & rows["source"].eqNullSafe(plan["_source"]) & (rows[md5] == plan["_digest"])).drop("_id", "_source", "_digest")
    part = F.floor(F.col(take)["extra"] / F.col(take)["n_rows"])
    lengths = F.concat(
        F.array_repeat(F.col(take)[size], F.when(F.col(take)[size] > 0, F.col(take)["whole"]).otherwise(1).cast("int")),
        F.when((F.col(take)[size] > 0) & (part > 0), F.array(part)).otherwise(F.array().cast("array<bigint>")),
    )
    out = joined.withColumn(turn, F.explode(lengths))
    whole = F.col(turn) >= F.col(take)[size]
    text = F.when(whole, F.col("text")).otherwise(first_words(F.col("text"), F.col(turn)))
    cells = {"text": text} | ({"n_chars": F.when(whole, F.col("n_chars")).otherwise(F.char_length(text).cast("long"))} if "n_chars" in docs.columns else {})
    return out.select(*[cells[c].alias(c) if c in cells else F.col(f"`{c}`") for c in docs.columns])


_SIZED = f"""
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents
"""

#: DuckDB twin of ``mixed_words`` with the default parameters, written as rounds of clamping over an ordered list.
MIX_SQL = f"""
WITH sized AS ({_SIZED}),
hashed AS (SELECT *, {seeded_hash_sql(SEED, "doc_id", "digest")} AS h FROM sized),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3]::DOUBLE AS weight
    FROM sized GROUP BY source),
ranked AS (
    SELECT *, 2.0 * source_size / weight AS full_at, (SELECT 1.5 * sum(source_size) FROM sources) AS share,
        coalesce(sum(2.0 * source_size) OVER w, 0) AS filled, (SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER w, 0) AS open
    FROM sources WINDOW w AS (ORDER BY 2.0 * source_size / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min((share - filled) / open, full_at) AS level FROM ranked WHERE full_at >= (share - filled) / open),
goal AS (SELECT source, source_size, CASE WHEN level IS NULL OR full_at <= level THEN 2.0 * source_size ELSE weight * level END::DOUBLE AS target FROM ranked, level),
plan AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target + 0.5) / source_size) AS BIGINT) ELSE 0 END AS whole FROM goal),
ordered AS (
    SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
        CAST(floor(p.target + 0.5) AS BIGINT) - p.whole * p.source_size - coalesce(sum(d.size) OVER (
            PARTITION BY d.source ORDER BY d.h % {BUCKETS}, d.h, d.doc_id, d.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free
    FROM hashed d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, free)) AS BIGINT) AS taken FROM ordered
"""
