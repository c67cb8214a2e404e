"""State windows, examples and the reproducible split."""

import json

from pyspark.sql import functions as F

from wayfold.operators import filters as FL
from wayfold.operators import training as TR
from wayfold.operators.flat import union_inputs
from wayfold.operators.snapshots import to_action_columns

KINDS = ["PAGE_LOAD", "CLICK", "API_CALL", "SCROLL", "TYPE", "CLICK", "CLICK"]


def actions(spark, sid="s", kinds=KINDS):
    rows = [(sid, i, i * 1.5, k, "a", "Buy" if i == 2 else "", "/x", "c", "down", 40, 3, "name", "/api", "/home") for i, k in enumerate(kinds, 1)]
    df = spark.createDataFrame(rows, "session_id STRING, step BIGINT, time DOUBLE, action STRING, target_tag STRING, target_text STRING, target_href STRING, target_class STRING, direction STRING, scroll_to BIGINT, text_length BIGINT, target_placeholder STRING, path STRING, url STRING")
    return to_action_columns(df)


def examples(spark, df):
    sessions = df.groupBy("session_id").agg(F.max("time").alias("session_duration_s"), F.count(F.lit(1)).alias("n_actions")).withColumn("cluster_id", F.lit(1).cast("long"))
    personas = TR.persona_text(spark.createDataFrame([(1, None, "", [], 61.5, 2.0)], "cluster_id BIGINT, label STRING, description STRING, key_behaviors ARRAY<STRING>, avg_duration_s DOUBLE, avg_actions DOUBLE"))
    return TR.training_examples(df, sessions, personas, TR.product_context("Shop"))


def test_examples(spark):
    both = union_inputs(actions(spark), actions(spark, "short", ["CLICK", "CLICK"]))
    rows = sorted(examples(spark, both).withColumn("messages", TR.as_messages()).collect(), key=lambda r: r.step)
    assert [r.step for r in rows] == [2, 4, 5, 6, 7]
    answer = json.loads(rows[0].assistant)
    assert answer == {"action": "click", "target": 'a "Buy"', "reasoning": "Exploring a element to interact with the product", "hesitation_ms": 1500}
    assert [m.role for m in rows[0].messages] == ["system", "user", "assistant"]
    assert rows[0].user == "Product: Shop\n\nSession: step 1, elapsed 1.5s / 11s\n\nRecent actions:\n  [1.5s] PAGE_LOAD /home\n\nWhat would you do next?"
    assert rows[-1].user.count("\n  [") == 5
    assert 'Your persona: "Cluster 1"' in rows[0].system and rows[0].system.endswith("Avg session: 62s, 2 actions")


def test_state_text_with_an_error(spark):
    row = TR.with_recent(actions(spark)).select("step", TR.state_text("P", F.lit(9.0), F.when(F.col("step") == 2, F.lit("no button"))).alias("s")).filter("step <= 2").orderBy("step").collect()
    assert row[0].s.endswith("What would you do next?") and "Recent" not in row[0].s
    assert row[1].s.endswith("Last action failed: no button\nDecide how to recover.")


def test_hesitation_truncates(spark):
    df = spark.createDataFrame([(0.3, 0.1), (0.1, 0.3), (1.239, None)], "t DOUBLE, p DOUBLE")
    assert [r[0] for r in df.select(TR.hesitation(F.col("t"), F.col("p"))).collect()] == [int((0.3 - 0.1) * 1000), 0, 1239]


def test_split_is_exact_for_a_hot_cluster(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") < 2_500, 0).when(F.col("id") < 2_999, 1).otherwise(2).alias("cluster_id"), "id")
    split = TR.sequence_split(rows, "cluster_id", ["id"])
    counts = {(r.cluster_id, r.split): r.examples for r in TR.training_counts(split).collect()}
    assert counts[(0, "val")] == 250 and counts[(1, "val")] == 49 and counts[(2, "val")] == 1 and (2, "train") not in counts
    assert counts[(None, None)] == 3_000 and split.select("id").distinct().count() == 3_000
    again = TR.sequence_split(rows.repartition(9), "cluster_id", ["id"])
    assert split.exceptAll(again).count() == 0
    assert split.exceptAll(TR.sequence_split(rows, "cluster_id", ["id"], seed=7)).count() > 0


def test_split_labels_examples_where_they_are(spark):
    """No exchange on the side of the examples, whatever Spark's own limit for broadcasts is."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for value in ("-1", "10m"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", value)
            rows = spark.range(500).select(F.pmod("id", F.lit(3)).alias("cluster_id"), "id", F.lit("text").alias("content"))
            plan = TR.sequence_split(rows, "cluster_id", ["id"])._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_next_action_fallbacks(spark):
    df = to_action_columns(spark.createDataFrame(
        [("s", 1, "CLICK", "", "", "", None), ("s", 2, "PAGE_LOAD", None, None, None, "/go/BACK"), ("s", 3, "PAGE_META", None, None, None, None)],
        "session_id STRING, step BIGINT, action STRING, target_text STRING, target_href STRING, target_class STRING, url STRING"))
    rows = df.select("step", TR.next_action().alias("n")).orderBy("step").collect()
    assert [(r.n.action, r.n.target) for r in rows] == [("click", "element"), ("navigate_back", "/go/BACK"), ("page_meta", "page")]


def test_filters(spark):
    df = actions(spark)
    assert FL.min_actions(df, 8).count() == 0 and FL.min_actions(df).first().n_actions == 7
    assert FL.real_actions(df).first().n_real_actions == 5
    urls = spark.createDataFrame([("https://user@Prod.Example.com:8080/a",), ("/rel?q=1",), ("https://home.example:81/",), (" https://home.example/x ",)], "u STRING")
    assert [r[0] for r in urls.select(FL.host_of(F.trim("u"))).collect()] == ["prod.example.com", "", "home.example", "home.example"]
    assert [r[0] for r in urls.select(FL.host_block(F.col("u"), ["prod."])).collect()] == [True, False, False, False]
    home = "https://home.example/start"
    assert [r[0] for r in urls.select(FL.same_domain_target(F.col("u"), home)).collect()] == [home, "https://home.example/rel?q=1", home, "https://home.example/x"]
