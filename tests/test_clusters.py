"""K-Means, balancing against the serial rule, exact ranks and distances."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import vectors as V
from wayfold.operators import clusters as C
from wayfold.operators import kmeans as K


def serial(points, centres):
    """Farthest point first, nearest cluster with room; ties by id."""
    n, k = len(points), len(centres)
    room = [n // k + (1 if n % k else 0)] * k
    dist = {i: [float(np.sqrt(((np.array(p) - np.array(c)) ** 2).sum())) for c in centres] for i, p in points}
    out = {}
    for i in sorted(dist, key=lambda i: (-min(dist[i]), i)):
        for c in sorted(range(k), key=lambda c: (dist[i][c], c)):
            if room[c]:
                room[c] -= 1
                out[i] = c
                break
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_balanced_equals_the_serial_rule(spark, seed):
    rng = random.Random(seed)
    copy = [rng.gauss(0, 1), rng.gauss(0, 1)]
    # A third of the points are copies of one another.
    points = [(i, copy if i % 3 == 0 else [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(61)]
    centres = [[0.1, 0.2], [0.3, 0.1], [2.0, 2.0], [-1.5, 0.4]]
    df = spark.createDataFrame(points, "id BIGINT, embedding ARRAY<DOUBLE>").repartition(3)
    table = spark.createDataFrame(list(enumerate(centres)), "cluster_id BIGINT, centroid ARRAY<DOUBLE>")
    got = {r.id: r.cluster_id for r in K.balanced_assign(df, table, "id").collect()}
    assert got == serial(points, centres)


def test_balanced_kmeans_capacity(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, [rng.gauss(i % 2, 0.2), rng.gauss(0, 1)]) for i in range(50)], "id BIGINT, embedding ARRAY<DOUBLE>")
    rows, _ = K.balanced_kmeans(df, 4, "id", starts=2)
    sizes = [r["count"] for r in rows.groupBy("cluster_id").count().collect()]
    assert sum(sizes) == 50 and max(sizes) <= 13


def test_more_starts_cost_no_more_and_k_shrinks(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(40)], "id BIGINT, embedding ARRAY<DOUBLE>")
    best = K.fit_kmeans(df, 5, starts=4).summary.trainingCost
    assert best <= K.fit_kmeans(df, 5, starts=1).summary.trainingCost
    assert len(K.fit_kmeans(df.limit(2), 5, starts=1).clusterCenters()) == 2


@pytest.mark.parametrize("descending", [True, False])
def test_select_rank_is_exact(spark, descending):
    rng = random.Random(5)
    rows = [(g, rng.choice([0.5, 1.25, rng.random()]) if g else 7.0) for g in (0, 1, 1, 1, 2) for _ in range(200)]
    df = spark.createDataFrame(rows, "slot INT, v DOUBLE")
    ranks = {0: 17, 1: 333, 2: 1}
    got = K.select_rank(df, "slot", "v", ranks, descending)
    for g, rank in ranks.items():
        values = sorted((v for s, v in rows if s == g), reverse=descending)
        value = values[rank - 1]
        assert got[g] == (value, rank - values.index(value))


@pytest.mark.parametrize("size", [2, 8, 18])
def test_blocks_of_centres_give_what_one_block_gives(spark, monkeypatch, size):
    """Equal rows and values, with copies of points, a null vector, equal centres and any block size."""
    rng = random.Random(6)
    rows = [(i, [rng.random(), rng.random()]) for i in range(20)] + [(3, [0.5, 0.5])] * 3 + [(99, None)]
    points = spark.createDataFrame(rows, "id BIGINT, embedding ARRAY<DOUBLE>").repartition(3)
    centres = [(i, [rng.random(), rng.random()]) for i in range(9)]
    table = spark.createDataFrame(centres + [(20, centres[0][1]), (-1, centres[4][1])], "cluster_id BIGINT, centroid ARRAY<DOUBLE>").repartition(4)
    pairs, near = (sorted(map(str, f(points, table).collect())) for f in (V.distance_matrix, V.nearest_centroid))
    monkeypatch.setattr(V, "BLOCK_VALUES", size)
    assert sorted(map(str, V.distance_matrix(points, table).collect())) == pairs and len(pairs) == 23 * 11
    assert sorted(map(str, V.nearest_centroid(points, table).collect())) == near and len(near) == 24
    want = {i: None if v is None else min((float(np.sqrt(((np.array(v) - np.array(c)) ** 2).sum())), k) for k, c in [*centres, (20, centres[0][1]), (-1, centres[4][1])])[1] for i, v in rows if i != 3}
    assert {(r.id, r.cluster_id) for r in V.nearest_centroid(points, table).collect() if r.id != 3} == set(want.items())


def test_no_centres_give_null(spark):
    points = spark.createDataFrame([(1, [0.0])], "id BIGINT, embedding ARRAY<DOUBLE>")
    table = spark.createDataFrame([], "cluster_id BIGINT, centroid ARRAY<DOUBLE>")
    assert [tuple(r) for r in V.nearest_centroid(points, table).select("cluster_id", "distance").collect()] == [(None, None)]
    assert V.distance_matrix(points, table).count() == 0


@pytest.mark.parametrize("listed,size", [(2, 6), (3, 100), (40, 6)])
def test_balanced_over_many_blocks_and_short_lists(spark, monkeypatch, listed, size):
    """Points that all their listed clusters reject go on with the next ones."""
    rng = random.Random(3)
    monkeypatch.setattr(K, "LISTED", listed)
    monkeypatch.setattr(V, "BLOCK_VALUES", size)
    points = [(i, [rng.gauss(0, 0.1), rng.gauss(0, 0.1)] if i % 4 else [0.0, 0.0]) for i in range(50)]
    centres = [[rng.gauss(0, 1), rng.gauss(0, 1)] for _ in range(12)]
    table = spark.createDataFrame(list(enumerate(centres)), "cluster_id BIGINT, centroid ARRAY<DOUBLE>").repartition(3)
    df = spark.createDataFrame(points, "id BIGINT, embedding ARRAY<DOUBLE>").repartition(3)
    assert {r.id: r.cluster_id for r in K.balanced_assign(df, table, "id").collect()} == serial(points, centres)


def test_profile_without_traits_and_ties(spark):
    rows = [(1, None, "", None, 10.0, 4), (1, None, None, None, 20.0, 5), (2, "b", "x", "low", 1.0, 1), (2, "a", "x", "low", 2.0, 1)]
    df = spark.createDataFrame(rows, "cluster_id INT, age_group STRING, country STRING, nyc_familiarity STRING, duration_s DOUBLE, n_actions INT")
    got = {r.cluster_id: r for r in C.cluster_profile(df, "cluster_id").collect()}
    assert (got[1].age_group, got[1].country, got[1].nyc_familiarity, got[1].avg_duration_s, got[1].avg_actions) == ("unknown", "unknown", "unknown", 15.0, 4.5)
    assert (got[2].age_group, got[2].country, got[2].country_distribution) == ("a", "x", {"x": 2})


def test_behaviours_need_all_words_where_asked(spark):
    rows = [(1, "They CLICK a lot"), (1, "and sign up fast"), (2, "click only"), (3, "nothing"), (4, "scroll type rage linear explore quick slow")]
    got = {r.c: r.key_behaviors for r in C.behaviour_keywords(spark.createDataFrame(rows, "c INT, t STRING"), "c", "t").collect()}
    assert got[1] == ["Attempts sign-up flow", "Fast-paced interaction"]
    assert got[2] == got[3] == ["General browsing behavior"]
    assert len(got[4]) == 5 and got[4][0] == "Scrolls to explore content"


def test_text_vectors_have_unit_length(spark):
    texts = spark.createDataFrame([(1, "a b c"), (2, "a a d"), (3, "e f")], "id INT, text STRING")
    rows = C.text_to_vector(C.text_vectorizer(texts, dims=64), texts).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in rows)
    again = C.text_to_vector(C.text_vectorizer(texts, dims=64), texts.filter("id = 2")).first()
    assert again.embedding == [r for r in rows if r.id == 2][0].embedding


def test_clusters_list_missing_sessions(spark):
    clusters = spark.createDataFrame([(0, ["a", "gone"]), (1, ["b"])], "cluster_id INT, session_ids ARRAY<STRING>")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "session_id STRING, step INT")
    assert C.cluster_members(clusters, rows).groupBy("cluster_id").count().orderBy("cluster_id").collect() == [(0, 2), (1, 1)]
    assert C.attach_cluster_label(clusters, clusters.select("cluster_id", F.lit(None).cast("string").alias("label"))).first().cluster_label.startswith("Cluster ")
