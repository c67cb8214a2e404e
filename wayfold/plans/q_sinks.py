"""Queries that write what they compute and read it back through the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayfold.functions.vectors import centroid_means, nearest_centroid
from wayfold.operators import agent as A
from wayfold.operators import kmeans as K
from wayfold.operators import reports as R
from wayfold.operators import training as TR
from wayfold.plans import bindings as B
from wayfold.plans import q_agent as QA
from wayfold.plans import q_snapshots as QS
from wayfold.plans import q_training as QT
from wayfold.plans.q_clusters import CENTROIDS
from wayfold.plans.q_flat import _flat
from wayfold.plans.registry import query
from wayfold.session import shared_folder
from wayfold.sources import readers as RD
from wayfold.sources import writers as WR


#: Files that one task writes where every row is a file.
FILES_A_TASK = 250


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/sink-{uuid.uuid4().hex}"


def _one_file_each(rows, path: str) -> None:
    """A file for each row, by as many tasks as the rows need, however few files the table is in."""
    rows.repartition(rows.count() // FILES_A_TASK + 1).write.option("maxRecordsPerFile", 1).json(path)


@query("read_recordings", "WITH " + B.SNAPSHOTS_SQL + """
SELECT CAST(session_id AS VARCHAR) AS session_id, count(*) AS snapshots, count(DISTINCT event_id // 1000) AS parts, sum(ts_ms)::BIGINT AS ms_sum, count(*) FILTER (WHERE kind = 'BAD') AS unreadable FROM snap GROUP BY 1""")
def read_recordings(t):
    """Recording parts written as JSON lines and read through the recording schema."""
    out = _folder(t)
    docs = B.recordings(t).select(F.lit("1").alias("version"), F.struct(F.col("session_id").cast("string").alias("id"), "snapshots").alias("data"))
    docs.write.json(out)
    items = RD.read_recordings(t.spark, out, one_per_file=False).select("session_id", "snapshots")
    bad = F.size(F.filter("snapshots", lambda s: s["data"] == "not json")).cast("long")
    ms = F.aggregate("snapshots", F.lit(0).cast("long"), lambda total, s: total + s["timestamp"])
    return items.groupBy("session_id").agg(F.sum(F.size("snapshots")).alias("snapshots"), F.count(F.lit(1)).alias("parts"), F.sum(ms).alias("ms_sum"), F.sum(bad).alias("unreadable"))


@query("read_flat_sessions", "WITH " + B.EVENTS_SQL + """
SELECT session_id || '-' || (event_id // 1000) AS session_id, count(*) AS events, floor(max(value) * 100 + 0.5) / 100 AS duration_ms, count(*) FILTER (WHERE event_id % 2 = 1) AS with_target FROM ev GROUP BY 1""")
def read_flat_sessions(t):
    """Flat sessions (a user's events of one id block) written as JSON lines and read back."""
    out = _folder(t)
    fields = F.struct("event_id", "event_type", "timestamp", "x", "y", "target_selector", "target_tag", "target_text", "scroll_y", "hover_duration_ms", "url")
    block = F.concat(F.col("session_id").cast("string"), F.lit("-"), F.floor(F.col("event_id") / 1000).cast("string"))
    rows = _flat(t).join(t.events.select("event_id", "value"), "event_id")
    rows.groupBy(block.alias("id")).agg(F.max("value").alias("duration_ms"), F.array_sort(F.collect_list(fields)).alias("events")).write.json(out)
    sessions = RD.read_flat_sessions(t.spark, out, one_per_file=False)
    counted = RD.flat_events(sessions).groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.count("target_tag").alias("with_target"))
    return counted.join(sessions.select("session_id", "duration_ms"), "session_id")


@query("read_agent_logs", "WITH " + B.AGENT_SQL + """
SELECT CAST(session_id AS VARCHAR) AS session_id, count(*) AS actions, count(*) FILTER (WHERE NOT success) AS errors, count(*) FILTER (WHERE skipped) AS skipped FROM agent GROUP BY 1""")
def read_agent_logs(t):
    """Agent logs written as JSON documents of bounded length and read back as action and error rows."""
    out = _folder(t)
    rows = B.agent_actions(t).withColumn("page", F.floor((F.col("step") - 1) / 1000))
    action = F.struct("step", "action_name", "timestamp", "relative_s", "duration_s", "success", "error", "page_url", F.struct("skipped").alias("details"))
    error = F.when(~F.col("success"), F.struct("step", F.col("action_name").alias("action"), "error", "relative_s"))
    rows.groupBy(F.col("session_id").cast("string").alias("session_id"), "page").agg(
        F.array_sort(F.collect_list(action)).alias("actions"), F.array_sort(F.collect_list(error)).alias("errors")).write.json(out)
    logs = RD.read_agent_logs(t.spark, out, one_per_file=False)
    errors = RD.agent_errors(logs).groupBy("session_id").agg(F.count(F.lit(1)).alias("errors"))
    counts = RD.agent_actions(logs).groupBy("session_id").agg(F.count(F.lit(1)).alias("actions"), F.count_if("skipped").alias("skipped"))
    return counts.join(errors, "session_id", "left").fillna(0, ["errors"])


@query("write_parsed", QT.WITH + "SELECT session_id, count(*) AS actions, max(step) AS last_step, max(\"time\") AS session_duration_s, count(target_text) AS texts FROM actions GROUP BY 1")
def write_parsed(t):
    out = _folder(t)
    actions = B.stored_actions(t)
    headers = actions.groupBy("session_id").agg(F.max("time").alias("session_duration_s"), F.count(F.lit(1)).alias("total_raw_events"))
    profiles = t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("age_group"))
    documents = WR.parsed_documents(actions, headers, profiles)
    WR.write_parsed(documents, out)
    rows = t.spark.read.schema(documents.schema).json(out).select("session_id", "session_duration_s", F.explode("high_level_actions").alias("a"))
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("actions"), F.max("a.step").alias("last_step"), F.max("session_duration_s").alias("session_duration_s"), F.count("a.target_text").alias("texts"))


@query("write_training", QT.EXAMPLES + """,
n AS (SELECT cluster_id, count(*) AS n, greatest(1, floor(count(*) * 0.1::DOUBLE)::BIGINT) AS v FROM examples GROUP BY 1)
SELECT cluster_id, 'val' AS split, v AS examples, 3 * v AS messages FROM n UNION ALL SELECT cluster_id, 'train', n - v, 3 * (n - v) FROM n WHERE n > v""")
def write_training(t):
    out = _folder(t)
    examples = TR.training_examples(B.stored_actions(t), QT._sessions(t), QT._personas(t), QT.CONTEXT)
    WR.write_training(TR.sequence_split(examples, "cluster_id", ["session_id", "step"]), out)
    schema = "messages ARRAY<STRUCT<role: STRING, content: STRING>>, cluster_id BIGINT, split STRING"
    back = t.spark.read.schema(schema).json(out)
    return back.groupBy("cluster_id", "split").agg(F.count(F.lit(1)).alias("examples"), F.sum(F.size("messages")).alias("messages"))


@query("write_report", "WITH " + B.AGENT_SQL + QA.SUMMARY + "SELECT session_id, total_actions, completion_rate FROM summary")
def write_report(t):
    """Two generations of report documents; the latest one of each session is read back."""
    out = _folder(t)
    summary = QA._summary(t)
    new = summary.select("session_id", F.lit("2024-01-02").alias("generated_at"), F.to_json(F.struct("total_actions", "completion_rate")).alias("report"))
    old = summary.select("session_id", F.lit("2024-01-01").alias("generated_at"), F.lit("{}").alias("report"))
    WR.write_report(old, out, "report")
    WR.write_report(new, out, "report")
    latest = WR.latest_report(t.spark.read.schema("session_id BIGINT, generated_at STRING, report STRING").json(out), "report")
    return latest.select("session_id", F.get_json_object("report", "$.total_actions").cast("long").alias("total_actions"),
                         F.get_json_object("report", "$.completion_rate").cast("double").alias("completion_rate"))


@query("save_model", "WITH" + CENTROIDS + "SELECT vec_id, arg_min(cluster_id, d) AS cluster_id FROM dist GROUP BY 1")
def save_model(t):
    """Centroids stored by a fit and by the label means; classification uses the preferred (real) ones."""
    out = _folder(t)
    points = t.embeddings.select("vec_id", "embedding")
    model = K.fit_kmeans(points, 5, starts=1)
    WR.save_model(model, K.centroid_table(model, points), out, "old")
    WR.save_model(model, centroid_means(t.embeddings, "label"), out, "real")
    return nearest_centroid(points, WR.load_centroids(t.spark, out)).select("vec_id", "cluster_id")


@query("load_older_model", "WITH" + CENTROIDS + "SELECT vec_id, arg_min(cluster_id, d) AS cluster_id FROM dist GROUP BY 1")
def load_older_model(t):
    """Only the older model is stored, so that classification falls back to it."""
    out = _folder(t)
    points = t.embeddings.select("vec_id", "embedding")
    WR.save_model(K.fit_kmeans(points, 5, starts=1), centroid_means(t.embeddings, "label"), out, "old")
    return nearest_centroid(points, WR.load_centroids(t.spark, out)).select("vec_id", "cluster_id")


@query("inventory_of_files", """
WITH kept(folder, step, files) AS (
  SELECT 'recordings', 'download', count(*) FROM supplier UNION ALL SELECT 'parsed', 'parse', count(*) FROM nation UNION ALL SELECT 'descriptions', 'describe', count(*) FROM region
  UNION ALL SELECT 'embeddings', 'embed', 0 UNION ALL SELECT 'clusters', 'cluster', 0 UNION ALL SELECT 'training', 'training', 0 UNION ALL SELECT 'models', 'finetune', 0 UNION ALL SELECT 'reports', 'agents', 0)
SELECT folder, step, files, files > 0 AS done FROM kept""")
def inventory_of_files(t):
    """One file for each row, as stored sessions are, written into some of the expected folders and counted there."""
    out = _folder(t)
    for folder, rows in {"recordings": t.supplier, "parsed": t.nation, "descriptions": t.region}.items():
        _one_file_each(rows.select(rows.columns[0]), f"{out}/{folder}")
    return RD.inventory(t.spark, out)


@query("parse_recordings", "WITH " + B.SNAPSHOTS_SQL + QS.RUNS + """,
steps AS (
  SELECT session_id, CASE WHEN kind = 'INPUT' THEN CASE WHEN k % 5 = 0 THEN k ELSE 2 * k END END AS text_length, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS step
  FROM (SELECT session_id, seq, kind, k FROM typed WHERE kind IN ('CLICK', 'INPUT', 'API_CALL', 'PAGE_META') UNION ALL SELECT session_id, seq, 'SCROLL', NULL FROM runs))
SELECT CAST(session_id AS VARCHAR) AS session_id, duration AS session_duration_s, n AS total_raw_events, n_actions, in_order
FROM (SELECT session_id, arg_max(relative_s, seq) AS duration FROM snap GROUP BY 1)
JOIN (SELECT session_id, count(*) AS n FROM typed GROUP BY 1) USING (session_id)
LEFT JOIN (SELECT session_id, count(*) AS n_actions, CAST(sum(step * coalesce(text_length, 1)) AS BIGINT) AS in_order FROM steps GROUP BY 1) USING (session_id)""")
def parse_recordings(t):
    """The recording reader, the session headers and the ordered actions, from files."""
    out = _folder(t)
    B.recordings(t).select(F.lit("1").alias("version"), F.struct(F.concat_ws(":", "session_id", "part").alias("id"), "snapshots").alias("data")).write.json(out)
    parts = RD.read_recordings(t.spark, out, one_per_file=False).select(
        F.substring_index("session_id", ":", 1).alias("session_id"), F.substring_index("session_id", ":", -1).cast("long").alias("part"), "snapshots")
    actions, headers = QS.S.parse_recordings(parts, part="part")
    counts = actions.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_actions"), F.sum(F.col("step") * F.coalesce("text_length", F.lit(1))).alias("in_order"))
    return headers.join(counts, "session_id", "left")
