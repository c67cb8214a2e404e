"""Queries over listings, stores, catalogues and retrain state."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions.exprs import epoch_micros
from wayfold.operators import agent as A
from wayfold.operators import catalogue as CA
from wayfold.operators import filters as FL
from wayfold.operators import online as O
from wayfold.plans.registry import query


@query("not_yet_processed", "SELECT o_orderkey AS session_id, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def not_yet_processed(t):
    orders = t.orders.select(F.col("o_orderkey").alias("session_id"), "o_custkey")
    return CA.not_yet_processed(orders, t.lineitem.select(F.col("l_orderkey").alias("session_id")))


@query("materialize_if_absent", """SELECT o_orderkey AS session_id, length(o_orderpriority) AS stage_output FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def materialize_if_absent(t):
    orders = t.orders.select(F.col("o_orderkey").alias("session_id"), "o_orderpriority", "o_orderstatus")
    done = orders.filter("o_orderstatus = 'F'")
    return CA.materialize_if_absent(orders, done, lambda df: df.select("session_id", F.length("o_orderpriority").cast("long").alias("stage_output")))


LISTING = """l AS (SELECT o_orderkey AS id, CASE WHEN s.k IS NOT NULL THEN 'skipped_existing' WHEN o_totalprice / 10000 < 10 THEN 'skipped_short' ELSE 'to_download' END AS bucket
  FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') s ON s.k = o_orderkey)"""


@query("download_candidates", "WITH " + LISTING + " SELECT bucket, count(*) AS recordings, sum(id)::BIGINT AS id_sum FROM l GROUP BY 1")
def download_candidates(t):
    listing = t.orders.select(F.col("o_orderkey").alias("recording_id"), (F.col("o_totalprice") / 10000).alias("recording_duration"))
    stored = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("recording_id"))
    return FL.download_candidates(listing, stored).groupBy("bucket").agg(F.count(F.lit(1)).alias("recordings"), F.sum("recording_id").alias("id_sum"))


@query("text_min_length", r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 100")
def text_min_length(t):
    return t.documents.filter(FL.text_min_length(F.col("text"))).select("doc_id")


@query("host_block", """SELECT page_id, host, contains(host, 'ads-track') OR contains(host, 'blog.') AS blocked
FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages)""")
def host_block(t):
    return t.pages.select("page_id", FL.host_of(F.col("url")).alias("host"), FL.host_block(F.col("url"), ["ads-track", "blog."]).alias("blocked"))


@query("same_domain_target", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://home.example' || path WHEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) <> 'home.example' THEN 'https://home.example/start'
  ELSE url END AS goes_to FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/]*(/.*)$', 1) AS path FROM pages)""")
def same_domain_target(t):
    asked = F.when(F.pmod("page_id", F.lit(2)) == 0, F.regexp_extract("url", r"^[a-z]+://[^/]*(/.*)$", 1)).otherwise(F.col("url"))
    return t.pages.select("page_id", FL.same_domain_target(asked, "https://home.example/start").alias("goes_to"))


@query("min_examples", """SELECT label::BIGINT AS cluster_id, count(*) AS examples, CASE WHEN count(*) >= 50 THEN 'ready' ELSE 'skipped' END AS status,
  CASE WHEN count(*) < 50 THEN 'Too few training examples (' || count(*) || ')' END AS reason FROM embeddings GROUP BY 1""")
def min_examples(t):
    counts = t.embeddings.groupBy(F.col("label").cast("long").alias("cluster_id")).agg(F.count(F.lit(1)).alias("examples"))
    return FL.min_examples(counts, 50)


@query("sessions_of_cluster", "SELECT vec_id AS session_id FROM embeddings WHERE label = 3")
def sessions_of_cluster(t):
    return FL.sessions_of_cluster(t.embeddings.withColumnRenamed("label", "cluster_id"), 3).select(F.col("vec_id").alias("session_id"))


TODO = r"""todo AS (SELECT d.doc_id AS session_id, l.quality::BIGINT AS quality, CASE WHEN p.k IS NOT NULL THEN 'skipped_exists'
  WHEN length(regexp_replace(d."text", '^\s+|\s+$', '', 'g')) < 100 THEN 'skipped_short' ELSE 'generate' END AS status
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id AS k FROM labels WHERE toxic = 1) p ON p.k = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


@query("todo_policies", "WITH " + TODO + " SELECT * FROM todo")
def todo_policies(t):
    texts = t.documents.select(F.col("doc_id").alias("session_id"), "text")
    made = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("session_id"))
    profiles = t.labels.select(F.col("doc_id").alias("session_id"), F.col("quality").cast("long").alias("quality"))
    return CA.todo_policies(texts, made, profiles).select("session_id", "quality", "status")


@query("cluster_catalog", """SELECT coalesce(n.id, s.id) AS cluster_id, coalesce(n_name, 'Cluster ' || coalesce(n.id, s.id)) AS label, s.id IS NOT NULL AS has_adapter
FROM (SELECT n_nationkey::BIGINT AS id, n_name FROM nation) n FULL JOIN (SELECT DISTINCT s_nationkey::BIGINT + 3 AS id FROM supplier) s ON n.id = s.id""")
def cluster_catalog(t):
    """Adapters are named three nations on, so that both sides have ids the other lacks."""
    clusters = t.nation.select(F.col("n_nationkey").cast("long").alias("cluster_id"), F.col("n_name").alias("label"))
    adapters = t.supplier.select((F.col("s_nationkey").cast("long") + 3).alias("cluster_id"))
    return CA.cluster_catalog(clusters, adapters)


@query("runnable_clusters", "SELECT c_custkey AS cluster_id, c_name AS label FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def runnable_clusters(t):
    models = t.orders.select(F.col("o_custkey").alias("cluster_id"), F.when(F.col("o_orderstatus") == "F", F.lit("success")).otherwise(F.lit("failed")).alias("status"), F.col("o_orderkey").alias("model_id"))
    return CA.runnable_clusters(t.customer.select(F.col("c_custkey").alias("cluster_id"), F.col("c_name").alias("label")), models)


@query("processing_status", """SELECT l.k AS session_id, CASE WHEN o.o_orderstatus = 'P' THEN 'pending' WHEN o.o_orderstatus = 'F' THEN 'completed' ELSE 'unknown' END AS status,
  CASE WHEN o.o_orderstatus = 'F' THEN o.o_custkey % 5 END AS cluster_id
FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) l LEFT JOIN orders o ON o.o_orderkey = l.k""")
def processing_status(t):
    ids = t.lineitem.select(F.col("l_orderkey").alias("session_id")).distinct()
    running = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("session_id"), F.lit("pending").alias("status"))
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("session_id"), F.pmod("o_custkey", F.lit(5)).alias("cluster_id"))
    return CA.processing_status(ids, running, done).select("session_id", "status", "cluster_id")


@query("prefer_real", """SELECT 'real' AS origin, s_suppkey AS cluster_id FROM supplier WHERE s_acctbal > 9000
UNION ALL SELECT 'old', s_suppkey FROM supplier WHERE s_acctbal <= 9000 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 9000)
UNION ALL SELECT 'fallback', s_suppkey FROM supplier""")
def prefer_real(t):
    rows = t.supplier.select("s_acctbal", F.col("s_suppkey").alias("cluster_id"))

    def named(df, origin):
        return df.select(F.lit(origin).alias("origin"), "cluster_id")

    real, old = rows.filter("s_acctbal > 9000"), rows.filter("s_acctbal <= 9000")
    missing = rows.filter("s_acctbal > 1000000")
    return CA.prefer_real(named(real, "real"), named(old, "old")).unionByName(CA.prefer_real(named(missing, "none"), named(rows, "fallback")))


@query("valid_clusters", """SELECT 'asked' AS request, n_nationkey::BIGINT AS cluster_id FROM nation WHERE n_nationkey IN (SELECT c_nationkey * 2 FROM customer)
UNION ALL SELECT 'all', n_nationkey::BIGINT FROM nation""")
def valid_clusters(t):
    available = t.nation.select(F.col("n_nationkey").cast("long").alias("cluster_id"))
    asked = t.customer.select((F.col("c_nationkey") * 2).cast("long").alias("cluster_id"))
    return CA.valid_clusters(available, asked).withColumn("request", F.lit("asked")).unionByName(CA.valid_clusters(available).withColumn("request", F.lit("all")))


STORE = """
processed AS (SELECT o_orderkey AS session_id, o_custkey % 5 AS cluster_id, o_orderdate AS processed_at FROM orders),
retrains AS (SELECT o_custkey AS job, min(o_orderdate) AS triggered_at FROM orders GROUP BY 1),
covered AS (SELECT job % 5 AS cluster_id, triggered_at FROM retrains UNION ALL SELECT job % 7, triggered_at FROM retrains),
lastr AS (SELECT cluster_id, max(triggered_at) AS t FROM covered GROUP BY 1),
fresh AS (SELECT p.* FROM processed p LEFT JOIN lastr USING (cluster_id) WHERE t IS NULL OR processed_at > t),
counts AS (SELECT cluster_id, count(DISTINCT session_id) AS new_sessions FROM fresh GROUP BY 1)"""


def processed(t):
    return t.orders.select(F.col("o_orderkey").alias("session_id"), F.pmod("o_custkey", F.lit(5)).alias("cluster_id"), F.col("o_orderdate").alias("processed_at"))


def retrains(t):
    jobs = t.orders.groupBy(F.col("o_custkey").alias("job_id")).agg(F.min("o_orderdate").alias("triggered_at"))
    return jobs.withColumn("cluster_ids", F.array(F.pmod("job_id", F.lit(5)), F.pmod("job_id", F.lit(7))))


@query("new_since_retrain", "WITH" + STORE + "SELECT session_id, cluster_id FROM fresh")
def new_since_retrain(t):
    return O.new_since_retrain(processed(t), retrains(t)).select("session_id", "cluster_id")


@query("retrain_ready", "WITH" + STORE + "SELECT * FROM counts WHERE new_sessions >= 2")
def retrain_ready(t):
    return O.retrain_ready(O.new_counts(processed(t), retrains(t)))


@query("pipeline_status", "WITH" + STORE + "SELECT (SELECT count(DISTINCT session_id) FROM processed) AS total_processed, string_agg(cluster_id || '=' || new_sessions, ',' ORDER BY cluster_id) AS new_counts FROM counts")
def pipeline_status(t):
    status = O.pipeline_status(processed(t), O.new_counts(processed(t), retrains(t)))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("cluster_new_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return status.select("total_processed", shown.alias("new_counts"))


@query("recent_sessions", "SELECT o_orderkey AS session_id, o_custkey % 5 AS cluster_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def recent_sessions(t):
    return O.recent_sessions(processed(t)).select("session_id", "cluster_id")


@query("page_of_listing", "SELECT o_orderkey AS recording_id, epoch_us(o_orderdate) AS started FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def page_of_listing(t):
    listing = t.orders.select(F.col("o_orderkey").alias("recording_id"), F.col("o_orderdate").alias("start_time"))
    return O.page_of_listing(listing).select("recording_id", epoch_micros(F.col("start_time")).alias("started"))


@query("retrain_history", """SELECT o_custkey AS job_id, epoch_us(min(o_orderdate)) AS triggered, epoch_us(max(o_orderdate)) AS updated, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status,
  arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS details FROM orders GROUP BY 1""")
def retrain_history(t):
    events = t.orders.select(F.col("o_custkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("details"),
                             F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("event_no"))
    return O.retrain_history(events).select("job_id", epoch_micros(F.col("triggered_at")).alias("triggered"), epoch_micros(F.col("updated_at")).alias("updated"), "status", "details")


@query("last_retrains_kept", """SELECT o_custkey % 5 AS cluster_id, o_orderkey, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey DESC) AS rank FROM orders) WHERE rank <= 5""")
def last_retrains_kept(t):
    rows = t.orders.select(F.pmod("o_custkey", F.lit(5)).alias("cluster_id"), "o_orderkey")
    return A.last_k(rows, ["cluster_id"], "o_orderkey", O.RECENT_RETRAINS)
