"""Queries over embeddings, descriptions and cluster membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import vectors as V
from wayfold.functions.exprs import rounded
from wayfold.operators import clusters as C
from wayfold.operators import kmeans as K
from wayfold.plans import bindings as B
from wayfold.plans.q_training import f0
from wayfold.plans.registry import query

CENTROIDS = """
parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
centroids AS (SELECT label::BIGINT AS cluster_id, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x) AS m FROM parts GROUP BY 1, 2) GROUP BY 1),
dist AS (SELECT vec_id, cluster_id, list_distance(embedding::DOUBLE[], centroid) AS d FROM embeddings CROSS JOIN centroids)"""


@query("centroid_means", "WITH" + CENTROIDS + "SELECT cluster_id, pos, floor(x * 1e6 + 0.5) / 1e6 AS mean FROM (SELECT cluster_id, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS pos FROM centroids)")
def centroid_means(t):
    """Every dimension of every mean."""
    dims = V.centroid_means(t.embeddings, "label").select("cluster_id", F.posexplode("centroid").alias("_p", "_x"))
    return dims.select("cluster_id", (F.col("_p") + 1).cast("long").alias("pos"), rounded(F.col("_x"), 6).alias("mean"))


@query("distance_matrix", "WITH" + CENTROIDS + "SELECT vec_id, cluster_id, floor(d * 1e6 + 0.5) / 1e6 AS distance FROM dist")
def distance_matrix(t):
    points = t.embeddings.select("vec_id", "embedding")
    return V.distance_matrix(points, V.centroid_means(t.embeddings, "label")).withColumn("distance", rounded(F.col("distance"), 6))


@query("nearest_centroid", "WITH" + CENTROIDS + "SELECT vec_id, arg_min(cluster_id, d) AS cluster_id, floor(min(d) * 1e6 + 0.5) / 1e6 AS distance FROM dist GROUP BY 1")
def nearest_centroid(t):
    points = t.embeddings.select("vec_id", "embedding")
    return V.nearest_centroid(points, V.centroid_means(t.embeddings, "label")).select("vec_id", "cluster_id", rounded(F.col("distance"), 6).alias("distance"))


@query("embedding_record", "SELECT vec_id AS session_id, len(embedding) AS embedding_dim, label FROM embeddings")
def embedding_record(t):
    vectors = t.embeddings.withColumnRenamed("vec_id", "session_id")
    return C.embedding_record(vectors, ["label"]).select("session_id", "embedding_dim", F.col("demographics.label"))


@query("kmeans")
def kmeans(t):
    """Best of ten starts; cluster numbers are arbitrary, so tests compare costs."""
    points = t.embeddings.select("vec_id", "embedding")
    return K.assign(K.fit_kmeans(points, 10), points).select("vec_id", "cluster_id")


@query("balanced_kmeans")
def balanced_kmeans(t):
    points = t.embeddings.select("vec_id", "embedding")
    rows, _ = K.balanced_kmeans(points, 10, "vec_id", starts=3)
    return rows.select("vec_id", "cluster_id")


@query("balanced_assign", "WITH RECURSIVE" + CENTROIDS + """,
prefs AS (SELECT vec_id, min(d) AS own, list(cluster_id ORDER BY d, cluster_id) AS pref FROM dist GROUP BY 1),
queue AS (SELECT *, row_number() OVER (ORDER BY own DESC, vec_id) AS pos FROM prefs),
cap AS (SELECT (count(*) + 9) // 10 AS cap FROM embeddings),
run AS (
  SELECT 0::BIGINT AS pos, NULL::BIGINT AS vec_id, NULL::BIGINT AS pick, [0, 0, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS used
  UNION ALL
  SELECT pos, vec_id, pick, list_transform(used, lambda u, i: u + CASE WHEN i = pick + 1 THEN 1 ELSE 0 END)
  FROM (SELECT q.pos, q.vec_id, r.used, list_filter(q.pref, lambda c: r.used[c + 1] < cap.cap)[1] AS pick
        FROM run r JOIN queue q ON q.pos = r.pos + 1 CROSS JOIN cap))
SELECT vec_id, pick AS cluster_id FROM run WHERE pos > 0""")
def balanced_assign(t):
    """Balancing from given centroids: the result is unique, so it has an exact twin."""
    points = t.embeddings.select("vec_id", "embedding")
    return K.balanced_assign(points, V.centroid_means(t.embeddings, "label"), "vec_id").select("vec_id", "cluster_id")


PEOPLE = """
people AS (SELECT c_custkey AS session_id, c_custkey % 4 AS cluster_id, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS age_group,
  CASE WHEN c_nationkey % 6 = 0 THEN '' ELSE 'n' || c_nationkey END AS country, abs(c_acctbal) AS duration_s, c_nationkey AS n_actions FROM customer)"""


@query("cluster_profile", "WITH" + PEOPLE + """,
a AS (SELECT cluster_id, age_group AS v, count(*) AS n FROM people WHERE age_group <> '' GROUP BY 1, 2),
c AS (SELECT cluster_id, country AS v, count(*) AS n FROM people WHERE country <> '' GROUP BY 1, 2)
SELECT cluster_id, count(*) AS size, floor(sum(floor(duration_s * 100 + 0.5)::BIGINT) / 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS avg_duration_s,
  floor(sum(n_actions) / count(*)::DOUBLE * 10 + 0.5) / 10 AS avg_actions,
  (SELECT v FROM a WHERE a.cluster_id = p.cluster_id ORDER BY n DESC, v LIMIT 1) AS age_group,
  (SELECT v FROM c WHERE c.cluster_id = p.cluster_id ORDER BY n DESC, v LIMIT 1) AS country, 'unknown' AS nyc_familiarity,
  (SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM a WHERE a.cluster_id = p.cluster_id) AS ages,
  (SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM c WHERE c.cluster_id = p.cluster_id) AS countries
FROM people p GROUP BY cluster_id""")
def cluster_profile(t):
    k = F.col("c_nationkey")
    people = t.customer.select(
        F.pmod("c_custkey", F.lit(4)).alias("cluster_id"), F.when(F.pmod(k, F.lit(5)) != 0, F.col("c_mktsegment")).alias("age_group"),
        F.when(F.pmod(k, F.lit(6)) == 0, F.lit("")).otherwise(F.concat(F.lit("n"), k.cast("string"))).alias("country"),
        F.lit(None).cast("string").alias("nyc_familiarity"), F.abs("c_acctbal").alias("duration_s"), k.alias("n_actions"))

    def shown(c):
        return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")

    return C.cluster_profile(people, "cluster_id").withColumns({"ages": shown("age_distribution"), "countries": shown("country_distribution")}).drop("age_distribution", "country_distribution")


WORDS = {0: " click", 1: " SIGN UP", 2: " scrolls", 3: " types", 4: " Rage", 5: " linear", 6: " explores", 7: " rapid", 8: " cautious"}


@query("behaviour_keywords", """
WITH d AS (SELECT source, lower("text" || CASE doc_id % 211 """ + " ".join(f"WHEN {k} THEN '{v}'" for k, v in WORDS.items()) + """ ELSE '' END) AS t FROM documents),
f AS (SELECT source, """ + ", ".join(f"bool_or(contains(t, '{w}')) AS {n}" for n, w in [
    ("click", "click"), ("sign", "sign up"), ("scroll", "scroll"), ("comment", "comment"), ("typ", "type"), ("rage", "rage"), ("linear", "linear"), ("explor", "explor"),
    ("quick", "quick"), ("rapid", "rapid"), ("fast", "fast"), ("slow", "slow"), ("cautious", "cautious"), ("deliberate", "deliberate")]) + """ FROM d GROUP BY 1),
l AS (SELECT source, list_filter([CASE WHEN click AND sign THEN 'Attempts sign-up flow' END, CASE WHEN scroll THEN 'Scrolls to explore content' END,
  CASE WHEN comment OR typ THEN 'Types and engages with forms' END, CASE WHEN rage THEN 'Shows frustration (rage clicks)' END, CASE WHEN linear THEN 'Linear navigation pattern' END,
  CASE WHEN explor THEN 'Exploratory browsing' END, CASE WHEN quick OR rapid OR fast THEN 'Fast-paced interaction' END,
  CASE WHEN slow OR cautious OR deliberate THEN 'Careful, deliberate actions' END], lambda x: x IS NOT NULL) AS b FROM f)
SELECT source, CASE WHEN len(b) = 0 THEN 'General browsing behavior' ELSE array_to_string(b[1:5], '|') END AS key_behaviors FROM l""")
def behaviour_keywords(t):
    marked = None
    for k, v in WORDS.items():
        hit = F.pmod("doc_id", F.lit(211)) == k
        marked = F.when(hit, F.lit(v)) if marked is None else marked.when(hit, F.lit(v))
    texts = t.documents.select("source", F.concat("text", marked.otherwise(F.lit(""))).alias("text"))
    return C.behaviour_keywords(texts, "source", "text").withColumn("key_behaviors", F.array_join("key_behaviors", "|"))


SESSIONS = "WITH " + B.ACTIONS_SQL + """,
sessions AS (SELECT session_id, max("time") AS session_duration_s, count(*) AS n_actions, count(*) FILTER (WHERE action NOT IN ('API_CALL', 'PAGE_LOAD')) AS n_real_actions FROM actions GROUP BY 1)"""


@query("cluster_label_rule", SESSIONS + """,
m AS (SELECT session_id % 20 AS cluster_id, count(*) AS size, sum(floor(session_duration_s / 100 * 100 + 0.5)::BIGINT % 40000) / 100.0::DOUBLE / count(*) AS avg_duration_s,
  sum(n_real_actions % 40) / count(*)::DOUBLE AS avg_actions FROM sessions GROUP BY 1)
SELECT *, CASE WHEN avg_duration_s < 60 AND avg_actions > 20 THEN 'Active Browser ' WHEN avg_duration_s > 200 THEN 'Deep Explorer ' WHEN avg_actions < 10 THEN 'Minimal User '
  ELSE 'Engaged User ' END || cluster_id AS label,
  'Cluster of ' || size || ' real user sessions with avg ' || """ + f0("avg_duration_s") + """ || 's duration and ' || """ + f0("avg_actions") + """ || ' actions' AS description FROM m""")
def cluster_label_rule(t):
    sessions = B.actions(t).groupBy("session_id").agg(F.max("time").alias("d"), F.count_if(~F.col("action").isin("API_CALL", "PAGE_LOAD")).alias("n"))
    cs = F.floor(F.col("d") / 100 * 100 + 0.5).cast("long")
    members = sessions.select(F.pmod("session_id", F.lit(20)).alias("cluster_id"), (F.pmod(cs, F.lit(40000)) / 100.0).alias("duration"), F.pmod("n", F.lit(40)).alias("acts"))
    return C.cluster_label_rule(members, "cluster_id", "duration", "acts")


@query("cluster_excerpts", """SELECT source, doc_id, rank, substr("text", 1, 500) AS excerpt
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 3""")
def cluster_excerpts(t):
    return C.cluster_excerpts(t.documents, "source", "doc_id", "text")


@query("complete_sessions", """SELECT v.vec_id AS session_id, l.quality::BIGINT AS quality, v.label::BIGINT AS label, coalesce(substr(d."text", 1, 500), '') AS description
FROM labels l JOIN embeddings v ON l.doc_id = v.vec_id LEFT JOIN documents d ON d.doc_id = v.vec_id""")
def complete_sessions(t):
    parsed = t.labels.select(F.col("doc_id").alias("session_id"), F.col("quality").cast("long").alias("quality"))
    vectors = t.embeddings.select(F.col("vec_id").alias("session_id"), F.col("label").cast("long").alias("label"))
    texts = t.documents.select(F.col("doc_id").alias("session_id"), "text")
    return C.complete_sessions(parsed, vectors, texts)


@query("attach_cluster_label", """SELECT c_custkey, c_nationkey::BIGINT AS cluster_id, coalesce(CASE WHEN n_nationkey % 4 <> 0 THEN n_name END, 'Cluster ' || c_nationkey) AS cluster_label
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def attach_cluster_label(t):
    named = F.when(F.pmod("n_nationkey", F.lit(4)) != 0, F.col("n_name"))
    names = t.nation.select(F.col("n_nationkey").cast("long").alias("cluster_id"), named.alias("label"))
    return C.attach_cluster_label(t.customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("cluster_id")), names)


@query("cluster_members", "SELECT n_regionkey::BIGINT AS cluster_id, c_nationkey::BIGINT AS session_id, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey")
def cluster_members(t):
    clusters = t.nation.groupBy(F.col("n_regionkey").cast("long").alias("cluster_id")).agg(F.collect_list(F.col("n_nationkey").cast("long")).alias("session_ids"))
    return C.cluster_members(clusters, t.customer.select(F.col("c_nationkey").cast("long").alias("session_id"), "c_custkey"))


@query("text_to_vector")
def text_to_vector(t):
    """Unit-length hashed term vectors of every document."""
    texts = t.documents.select("doc_id", "text")
    return C.text_to_vector(C.text_vectorizer(texts, dims=256), texts).select("doc_id", F.size("embedding").cast("long").alias("dims"), "embedding")


@query("behaviour_features", SESSIONS + """
SELECT session_id, count(*) AS n_actions, count(*) FILTER (WHERE action = 'CLICK') AS clicks,
  floor((max(cs) FILTER (WHERE action = 'CLICK') - min(cs) FILTER (WHERE action = 'CLICK'))::DOUBLE / nullif((count(*) FILTER (WHERE action = 'CLICK') - 1) * 100, 0) * 100 + 0.5) / 100 AS mean_click_gap_s,
  coalesce(max(max_depth), 0) AS max_scroll_depth, floor(coalesce(sum(floor(duration_s * 100 + 0.5)), 0)::DOUBLE / nullif(max(cs), 0) * 10000 + 0.5) / 10000 AS scroll_time_share,
  coalesce(sum(text_length), 0)::BIGINT AS typed_chars, count(*) FILTER (WHERE action = 'TYPE') AS type_events, count(DISTINCT nullif(target_text, '')) AS distinct_targets,
  count(url) - count(DISTINCT url) AS url_revisits, floor((count(*) * 6000)::DOUBLE / nullif(max(cs), 0) * 10000 + 0.5) / 10000 AS actions_per_min
FROM (SELECT *, floor("time" * 100 + 0.5)::BIGINT AS cs FROM actions) GROUP BY 1""")
def behaviour_features(t):
    return C.behaviour_features(B.actions(t))


@query("policy_features", SESSIONS + """,
c AS (SELECT session_id, (step - 1) * 3 // n_actions AS third, action, count(*) AS n FROM actions JOIN sessions USING (session_id) GROUP BY 1, 2, 3),
top AS (SELECT *, row_number() OVER (PARTITION BY session_id, third ORDER BY n DESC, action) AS rn FROM c)
SELECT s.session_id, session_duration_s AS session_target_duration_s, floor(ty / n_actions::DOUBLE * 1000 + 0.5) / 1000 AS comment_probability,
  floor(ap / n_actions::DOUBLE * 1000 + 0.5) / 1000 AS vote_probability,
  CASE WHEN session_duration_s / nullif(n_actions - 1, 0) < 2 THEN 'fast' WHEN session_duration_s / nullif(n_actions - 1, 0) < 6 THEN 'medium' ELSE 'slow' END AS browsing_speed,
  e AS early_session, m AS mid_session, l AS late_session
FROM sessions s JOIN (SELECT session_id, coalesce(sum(n) FILTER (WHERE action = 'TYPE'), 0) AS ty, coalesce(sum(n) FILTER (WHERE action = 'API_CALL'), 0) AS ap FROM c GROUP BY 1) r USING (session_id)
JOIN (SELECT session_id, max(action) FILTER (WHERE third = 0) AS e, max(action) FILTER (WHERE third = 1) AS m, max(action) FILTER (WHERE third = 2) AS l FROM top WHERE rn = 1 GROUP BY 1) d USING (session_id)""")
def policy_features(t):
    actions = B.stored_actions(t).select("session_id", "step", "time", "action")
    sessions = actions.groupBy("session_id").agg(F.max("time").alias("session_duration_s"), F.count(F.lit(1)).alias("n_actions"))
    return C.policy_features(actions, sessions)
