"""Streaming jobs run over the driver tables until their input is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayfold.functions.exprs import epoch_micros
from wayfold.functions.vectors import centroid_means
from wayfold.plans import bindings as B
from wayfold.plans.q_catalogue import STORE, processed, retrains
from wayfold.plans.q_text import ID_SQL, webhook_bodies
from wayfold.plans.registry import Tables, query
from wayfold.session import shared_folder
from wayfold.streaming import jobs as J


class StreamTables(Tables):
    """The same tables read as streams of landed files: a table is one file, or a folder of them."""

    def __getattr__(self, name):
        schema = Tables(self.spark, self.folder).__getattr__(name).schema
        # A pattern, since a stream takes only a folder by its plain name.
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}.parque[t]")


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _drain(writer, folder):
    J.start(writer, f"{folder}/checkpoint", once=True).awaitTermination()


def _streams(t):
    return StreamTables(t.spark, t.folder)


@query("stream_new_recordings", "SELECT event_id, user_id AS session_id FROM events")
def stream_new_recordings(t):
    out = _folder(t)
    rows = _streams(t).events.select("event_id", F.col("user_id").alias("session_id"))
    _drain(rows.writeStream.format("parquet").option("path", f"{out}/rows"), out)
    return t.spark.read.parquet(f"{out}/rows")


@query("stream_landed_recordings", "WITH " + B.SNAPSHOTS_SQL + """,
landed AS (SELECT session_id, event_id // 1000 AS part, count(*) AS snapshots, sum(ts_ms)::BIGINT AS ms_sum FROM snap GROUP BY 1, 2),
near AS (SELECT session_id, part, snapshots, ms_sum, r_regionkey AS c, row_number() OVER (PARTITION BY session_id, part ORDER BY abs(snapshots - 3 * r_regionkey), r_regionkey) AS r FROM landed CROSS JOIN region)
SELECT session_id || ':' || part AS session_id, snapshots, ms_sum, c::BIGINT AS cluster_id, r_name AS cluster_label FROM near JOIN region ON r_regionkey = c WHERE r = 1""")
def stream_landed_recordings(t):
    """Recording parts that land as files, taken in several batches, each classified by the model of its time."""
    out = _folder(t)
    docs = B.recordings(t).select(F.struct(F.concat_ws(":", "session_id", "part").alias("id"), "snapshots").alias("data"))
    docs.repartition(3, "data.id").write.json(f"{out}/landing")
    centres = t.region.select(F.col("r_regionkey").alias("cluster_id"), F.array((F.col("r_regionkey") * 3).cast("double")).alias("centroid"))
    J.publish_model(centres, t.region.select(F.col("r_regionkey").alias("cluster_id"), F.col("r_name").alias("label")), f"{out}/model", 1)
    ms = F.aggregate("snapshots", F.lit(0).cast("long"), lambda total, s: total + s["timestamp"])
    size = F.size("snapshots").cast("long")
    parts = J.new_recordings(t.spark, f"{out}/landing", max_files=1, one_per_file=False).select(
        "session_id", size.alias("num_actions"), F.array(size.cast("double")).alias("embedding"), ms.cast("string").alias("description"))
    _drain(parts.writeStream.foreachBatch(J.classify_to_table(f"{out}/rows", J.LatestModel(t.spark, f"{out}/model"), at_least=0)), out)
    return t.spark.read.parquet(f"{out}/rows").select(
        "session_id", F.col("num_actions").alias("snapshots"), F.col("description_preview").cast("long").alias("ms_sum"), "cluster_id", "cluster_label")


@query("stream_dedupe", "SELECT DISTINCT user_id AS session_id FROM events")
def stream_dedupe(t):
    out = _folder(t)
    rows = _streams(t).events.select(F.col("user_id").alias("session_id"))
    _drain(J.dedupe_stream(rows).writeStream.foreachBatch(J.batches_to_table(f"{out}/rows")), out)
    return t.spark.read.parquet(f"{out}/rows").select("session_id")


@query("stream_classify", """WITH
parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
centroids AS (SELECT label::BIGINT AS cluster_id, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x) AS m FROM parts GROUP BY 1, 2) GROUP BY 1),
near AS (SELECT vec_id, arg_min(cluster_id, list_distance(embedding::DOUBLE[], centroid)) AS c FROM embeddings CROSS JOIN centroids GROUP BY 1)
SELECT vec_id AS session_id, CASE WHEN label < 3 OR vec_id % 11 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN label < 3 THEN 'parse' WHEN vec_id % 11 = 0 THEN 'embed' ELSE 'classify' END AS stage,
  CASE WHEN label >= 3 AND vec_id % 11 <> 0 THEN c END AS cluster_id, CASE WHEN label >= 3 AND vec_id % 11 <> 0 THEN coalesce((SELECT r_name FROM region WHERE r_regionkey = c), 'Cluster ' || c) END AS cluster_label
FROM embeddings JOIN near USING (vec_id)""")
def stream_classify(t):
    out = _folder(t)
    labels = t.region.select(F.col("r_regionkey").cast("long").alias("cluster_id"), F.col("r_name").alias("label"))
    rows = _streams(t).embeddings.select(
        F.col("vec_id").alias("session_id"), F.col("label").alias("num_actions"), F.when(F.pmod("vec_id", F.lit(11)) != 0, F.col("embedding")).alias("embedding"))
    J.publish_model(centroid_means(t.embeddings, "label"), labels, f"{out}/model", 1)
    _drain(rows.writeStream.foreachBatch(J.classify_to_table(f"{out}/rows", J.LatestModel(t.spark, f"{out}/model"))), out)
    return t.spark.read.parquet(f"{out}/rows").select("session_id", "status", "stage", "cluster_id", "cluster_label")


@query("stream_cluster_counts", "WITH" + STORE + "SELECT cluster_id, new_sessions, new_sessions >= 2 AS ready FROM counts")
def stream_cluster_counts(t):
    out = _folder(t)
    _drain(processed(_streams(t)).writeStream.foreachBatch(J.count_to_table(f"{out}/counts", lambda: retrains(t))), out)
    return J.current_counts(t.spark, f"{out}/counts", retrains(t), threshold=2)


@query("stream_webhook", "WITH " + ID_SQL + """
SELECT event_id, recording_id, CASE WHEN recording_id IS NULL THEN 'ignored' WHEN recording_id IN (SELECT 'rec' || n_nationkey FROM nation UNION ALL SELECT 'data' || n_nationkey FROM nation) THEN 'skipped' ELSE 'accepted' END AS status
FROM ids""")
def stream_webhook(t):
    out = _folder(t)
    known = t.nation.select(F.explode(F.array(*[F.concat(F.lit(p), F.col("n_nationkey").cast("string")) for p in ("rec", "data")])).alias("session_id"))
    rows = J.webhook_status(webhook_bodies(_streams(t)), known).select("event_id", "recording_id", "status")
    _drain(rows.writeStream.format("parquet").option("path", f"{out}/rows"), out)
    return t.spark.read.parquet(f"{out}/rows")


@query("stream_stuck", """
WITH e AS (SELECT user_id AS session_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS nxt, (SELECT epoch_us(max(ts)) FROM events) AS last FROM events)
SELECT session_id, us AS last_action_us, us + 21600000001 AS stuck_us FROM e WHERE (nxt IS NULL OR nxt - us > 21600000000) AND (us + 21600000001) // 1000 <= last // 1000 - 60000""")
def stream_stuck(t):
    out = _folder(t)
    actions = _streams(t).events.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    stuck = J.stuck_stream(actions, timeout_s=21_600)
    _drain(stuck.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows"), out)
    return t.spark.read.parquet(f"{out}/rows").select(
        "session_id", epoch_micros(F.col("last_action")).alias("last_action_us"), epoch_micros(F.col("stuck_at")).alias("stuck_us"))


@query("stream_stuck_clock", """
WITH e AS (SELECT user_id AS session_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events)
SELECT session_id, us AS last_action_us, us + 21600000001 AS stuck_us FROM e WHERE nxt - us > 21600000000""")
def stream_stuck_clock(t):
    """Pauses by keyed state and timers; the input ends before the clock could report the last one of a session."""
    out = _folder(t)
    actions = _streams(t).events.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    writer = J.stuck_clock(actions, timeout_s=21_600).writeStream.format("parquet").option("path", f"{out}/rows")
    J.stop_when_idle(J.start(writer, f"{out}/checkpoint", every="1 second"))
    return t.spark.read.parquet(f"{out}/rows").select(
        "session_id", epoch_micros(F.col("last_action")).alias("last_action_us"), epoch_micros(F.col("stuck_at")).alias("stuck_us"))
