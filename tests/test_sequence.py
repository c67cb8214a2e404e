"""Segmented sequences against plain Python, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators.sequence import Sequence, best_per_key, cut_points, paged, with_lookback

MICROS = 1_000_000


def make_rows(seed: int, hot: int = 600, cold: int = 40) -> list[tuple]:
    """(key, us, event_id, v): key 0 holds most rows, times repeat, values may be null."""
    rng = random.Random(seed)
    keys = [0] * hot + [rng.randrange(1, 9) for _ in range(cold)]
    rows = [(k, rng.randrange(0, 1_800) * MICROS, i, rng.choice([None, rng.randrange(100)])) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    return rows


def brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == key)
        running, known, before = 0, None, None
        for step, (_, eid, v) in enumerate(mine, start=1):
            known_before = known
            running += v or 0
            known = v if v is not None else known
            out[(key, eid)] = (step, running, known, known_before, before, mine[0][2], mine[-1][2], len(mine))
            before = v
    return out


@pytest.mark.parametrize("seed,segments,least", [(1, 64, 1), (2, 8, 40), (3, 8, 10_000), (4, 1000, 1)])
def test_all_columns(spark, seed, segments, least):
    rows = make_rows(seed)
    df = spark.createDataFrame(rows, "key BIGINT, us BIGINT, event_id BIGINT, v BIGINT").repartition(7)
    v = F.col("v")
    got = (
        Sequence(df, ["key"], ["us", "event_id"], segments, least)
        .number("step").running_sum("run", v).last_known("known", v).last_known("known_before", v, inclusive=False)
        .previous("prev", v).first("first", v).last("last", v).total("n", F.count(F.lit(1)), F.sum).build().collect()
    )
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        assert (r.step, r.run, r.known, r.known_before, r.prev, r.first, r.last, r.n) == want[(r.key, r.event_id)]


def largest_window(df, keys, order, segments, least):
    """Rows of the largest (key, segment), by the cut points."""
    cuts = cut_points(df, keys, order, segments, least)
    here = F.struct(*order)
    rows = df.join(cuts, F.struct(*[df[k] for k in keys]) == cuts["_k"], "left")
    segment = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= here)))
    sizes = rows.groupBy(*keys, segment.alias("s")).count()
    return sizes.agg(F.max("count"), F.count(F.lit(1))).first()


@pytest.mark.parametrize("us", ["id * 86400000000", "id % 60", "CASE WHEN id % 3 > 0 THEN id END", "CAST(NULL AS BIGINT)"])
def test_windows_are_bounded_for_sparse_dense_and_null_orders(spark, us):
    """A session of 30,000 rows a day apart, in one dense minute, or mostly without an order value."""
    df = spark.range(40_000).select(F.when(F.col("id") < 30_000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("key"), F.expr(us).alias("us"), "id")
    most, parts = largest_window(df, ["key"], ["us", "id"], 32, 1)
    assert most <= 3 * 40_000 / 32 and parts <= 501 + 2 * 32
    built = Sequence(df, ["key"], ["us", "id"], 32, 1).number("step").first("f", F.col("id")).build().filter("key = 'hot'")
    want = sorted((r["us"] is not None, r["us"] or 0, r["id"]) for r in df.filter("key = 'hot'").select("us", "id").collect())
    assert [(r["id"], r["f"]) for r in built.orderBy("step").select("id", "f").collect()] == [(w[2], want[0][2]) for w in want]


def test_rows_are_shuffled_once(spark):
    """Everything else that is exchanged is the sample, the summaries of cut keys, and broadcasts of both."""
    df = spark.range(20_000).select(F.when(F.col("id") < 15_000, 1).otherwise(F.col("id")).alias("key"), "id", (F.col("id") * MICROS).alias("us"), F.lit("a wide column").alias("wide"))
    built = Sequence(df, ["key"], ["us", "id"], 16, 1).number("step").last_known("k", F.col("id")).first("f", F.col("id")).build()
    plan = built._jdf.queryExecution().sparkPlan().toString()
    full = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == plan.count("Join") == 3
    rows = [line for line in full.splitlines() if "Exchange hashpartitioning(key#" in line and "_segment#" in line]
    assert len(rows) == 1
    assert built.agg(F.sum("step")).first()[0] == 15_000 * 15_001 // 2 + 5_000


def test_null_order_values_come_first(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 70 * MICROS, 6), (1, 1 * MICROS, 7)], "key BIGINT, us BIGINT, id BIGINT")
    got = Sequence(df, ["key"], ["us", "id"], 64, 1).number("step").build()
    assert {r.id: r.step for r in got.collect()} == {5: 1, 7: 2, 6: 3}


@pytest.mark.parametrize("page_rows", [3, 7, 1000])
def test_lookback_crosses_pages(spark, page_rows):
    df = spark.range(1, 101).select(F.lit("s").alias("session_id"), F.col("id").alias("step"))

    def columns(w):
        return {"recent": F.collect_list("step").over(w.rowsBetween(-3, -1)), "before": F.lag("step").over(w)}

    rows = with_lookback(df, ["session_id"], "step", 3, columns, page_rows).collect()
    assert len(rows) == 100
    for r in rows:
        assert r.recent == list(range(max(1, r.step - 3), r.step)) and r.before == (r.step - 1 or None)


def test_lookback_needs_room(spark):
    with pytest.raises(ValueError):
        with_lookback(spark.range(1).withColumn("step", F.lit(1)), ["id"], "step", 5, lambda w: {}, page_rows=4)


def test_pages_hold_everything_in_order(spark):
    df = spark.range(1, 26).select(F.lit("s").alias("session_id"), F.col("id").alias("step"), F.concat(F.lit("v"), F.col("id")).alias("v")).repartition(5)
    rows = sorted(paged(df, ["session_id"], "step", F.col("v"), "vs", page_rows=10).collect(), key=lambda r: r.page)
    assert [len(r.vs) for r in rows] == [10, 10, 5]
    assert [x for r in rows for x in r.vs] == [f"v{i}" for i in range(1, 26)]


def test_best_per_key_limits_groups_before_the_shuffle(spark):
    df = spark.range(5_000).select(F.when(F.col("id") >= 0, 1).otherwise(2).alias("key"), "id")
    top = best_per_key(df, ["key"], [F.col("id").desc()], 3)
    assert [r.id for r in sorted(top.collect(), key=lambda r: r["rank"])] == [4999, 4998, 4997]
    assert top._jdf.queryExecution().sparkPlan().toString().count("WindowGroupLimit") == 2


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k STRING, pos INT")
    got = Sequence(df, ["k"], ["pos"], 64, 1).number().build().collect()
    assert sorted((str(r.k), r.pos, r.step) for r in got) == [("None", 1, 1), ("None", 2, 2), ("a", 1, 1)]
