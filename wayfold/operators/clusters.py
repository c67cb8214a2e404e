"""Cluster profiles, labels, members and per-session feature rows."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.exprs import centis, fixed0, ratio, rounded
from wayfold.operators.sequence import best_per_key

EXCERPT_CHARS = 500
EXCERPTS_PER_CLUSTER = 3

# Words (any of, all of) that reveal a behaviour, and its name, in order of priority.
BEHAVIOUR_RULES = [
    (["click", "sign up"], all, "Attempts sign-up flow"),
    (["scroll"], any, "Scrolls to explore content"),
    (["comment", "type"], any, "Types and engages with forms"),
    (["rage"], any, "Shows frustration (rage clicks)"),
    (["linear"], any, "Linear navigation pattern"),
    (["explor"], any, "Exploratory browsing"),
    (["quick", "rapid", "fast"], any, "Fast-paced interaction"),
    (["slow", "cautious", "deliberate"], any, "Careful, deliberate actions"),
]
DEFAULT_BEHAVIOUR = "General browsing behavior"
MAX_BEHAVIOURS = 5


def behaviour_keywords(members: DataFrame, cluster: str, text: str) -> DataFrame:
    """``(cluster, key_behaviors)``: one boolean per word and cluster, combined map-side over whole texts."""
    words = list(dict.fromkeys(w for group, _, _ in BEHAVIOUR_RULES for w in group))
    low = members.select(cluster, F.lower(text).alias("_t"))
    found = low.groupBy(cluster).agg(*[F.coalesce(F.bool_or(F.col("_t").contains(w)), F.lit(False)).alias(f"w{i}") for i, w in enumerate(words)])
    named = []
    for group, how, name in BEHAVIOUR_RULES:
        flags = [F.col(f"w{words.index(w)}") for w in group]
        hit = flags[0]
        for flag in flags[1:]:
            hit = hit & flag if how is all else hit | flag
        named.append(F.when(hit, F.lit(name)))
    listed = F.slice(F.array_compact(F.array(*named)), 1, MAX_BEHAVIOURS)
    return found.select(cluster, F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(DEFAULT_BEHAVIOUR))).alias("key_behaviors"))


def cluster_label_rule(members: DataFrame, cluster: str, duration: str, n_actions: str) -> DataFrame:
    """Size, means, label and description of each cluster."""
    means = members.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"),
        (F.sum(centis(F.col(duration))) / F.lit(100.0) / F.count(F.lit(1))).alias("avg_duration_s"),
        (F.sum(n_actions) / F.count(F.lit(1))).alias("avg_actions"),
    )
    seconds, acts, tail = F.col("avg_duration_s"), F.col("avg_actions"), F.concat(F.lit(" "), F.col(cluster).cast("string"))
    kind = (
        F.when((seconds < 60) & (acts > 20), F.lit("Active Browser"))
        .when(seconds > 200, F.lit("Deep Explorer"))
        .when(acts < 10, F.lit("Minimal User"))
        .otherwise(F.lit("Engaged User"))
    )
    words = F.concat(F.lit("Cluster of "), F.col("size").cast("string"), F.lit(" real user sessions with avg "),
                     fixed0(seconds), F.lit("s duration and "), fixed0(acts), F.lit(" actions"))
    return means.withColumns({"label": F.concat(kind, tail), "description": words})


TRAITS = ["age_group", "country", "nyc_familiarity"]


def trait_counts(members: DataFrame, cluster: str, traits: list[str] | None = None) -> DataFrame:
    """``(cluster, trait, value, n)`` of the known trait values."""
    traits = traits or TRAITS
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t).alias("value")) for t in traits])).alias("_p")
    return (
        members.select(cluster, pairs).select(cluster, "_p.trait", "_p.value")
        .filter(F.coalesce("value", F.lit("")) != "")
        .groupBy(cluster, "trait", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def cluster_profile(members: DataFrame, cluster: str, duration: str = "duration_s", n_actions: str = "n_actions") -> DataFrame:
    """Size, means, dominant traits (alphabetically first on a tie, ``unknown`` without data) and two distributions."""
    sizes = members.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"),
        rounded(F.sum(centis(F.col(duration))) / F.lit(100.0) / F.count(F.lit(1)), 1).alias("avg_duration_s"),
        rounded(F.sum(n_actions) / F.count(F.lit(1)), 1).alias("avg_actions"),
    )
    counts = trait_counts(members, cluster)

    def of(trait: str, c: Column) -> Column:
        return F.when(F.col("trait") == trait, c)

    top = [F.min_by(of(t, F.col("value")), of(t, F.struct(-F.col("n"), F.col("value")))).alias(t) for t in TRAITS]
    maps = [
        F.map_from_entries(F.array_sort(F.collect_list(of(t, F.struct("value", "n"))))).alias(name)
        for t, name in (("age_group", "age_distribution"), ("country", "country_distribution"))
    ]
    shapes = counts.groupBy(cluster).agg(*top, *maps)
    return sizes.join(shapes, cluster, "left").withColumns({t: F.coalesce(t, F.lit("unknown")) for t in TRAITS})


def cluster_excerpts(members: DataFrame, cluster: str, id_: str, text: str, k: int = EXCERPTS_PER_CLUSTER) -> DataFrame:
    """First ``k`` members of each cluster with the start of their description."""
    first = best_per_key(members.select(cluster, id_, F.substring(text, 1, EXCERPT_CHARS).alias("excerpt")), [cluster], [F.col(id_)], k)
    return first


def complete_sessions(parsed: DataFrame, embeddings: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Sessions with actions and an embedding; the description is optional and excerpted."""
    texts = descriptions.select("session_id", F.substring("text", 1, EXCERPT_CHARS).alias("description"))
    return parsed.join(embeddings, "session_id").join(texts, "session_id", "left").fillna("", ["description"])


def attach_cluster_label(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """Adds ``cluster_label``; a cluster without a label is called by its id."""
    names = clusters.select("cluster_id", "label")
    fallback = F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))
    return assigned.join(names, "cluster_id", "left").withColumn("cluster_label", F.coalesce("label", fallback)).drop("label")


def cluster_members(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the sessions a cluster lists; listed sessions without rows are skipped."""
    listed = clusters.select("cluster_id", F.explode("session_ids").alias("session_id"))
    return listed.join(rows, "session_id")


def text_vectorizer(texts: DataFrame, text: str = "text", dims: int = 1_024) -> PipelineModel:
    """Local stand-in for a remote embedding model: hashed, idf-weighted, unit-length term vectors."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vector"),
    ]).fit(texts)


def text_to_vector(model: PipelineModel, texts: DataFrame) -> DataFrame:
    """Adds ``embedding ARRAY<DOUBLE>``."""
    return model.transform(texts).withColumn("embedding", vector_to_array("_vector")).drop("_tokens", "_tf", "_idf", "_vector")


def embedding_record(vectors: DataFrame, demographics: list[str]) -> DataFrame:
    """The stored embedding record of a session."""
    return vectors.select("session_id", F.struct(*demographics).alias("demographics"),
                          F.size("embedding").cast("long").alias("embedding_dim"), "embedding")


def behaviour_features(actions: DataFrame) -> DataFrame:
    """One numeric row per session along the dimensions a behavioural description covers."""
    kind, time = F.col("action"), F.col("time")
    click = kind == "CLICK"
    cs = centis(time)
    facts = actions.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_actions"),
        F.count_if(click).alias("clicks"),
        (F.max(F.when(click, cs)) - F.min(F.when(click, cs))).alias("_click_span"),
        F.coalesce(F.max("max_depth"), F.lit(0)).alias("max_scroll_depth"),
        F.coalesce(F.sum(centis(F.col("duration_s"))), F.lit(0)).alias("_scroll_cs"),
        F.max(cs).alias("_span"),
        F.coalesce(F.sum("text_length"), F.lit(0)).alias("typed_chars"),
        F.count_if(kind == "TYPE").alias("type_events"),
        F.count_distinct(F.nullif("target_text", F.lit(""))).alias("distinct_targets"),
        (F.count("url") - F.count_distinct("url")).alias("url_revisits"),
    )
    return facts.select(
        "session_id", "n_actions", "clicks",
        ratio(F.col("_click_span"), (F.col("clicks") - 1) * 100).alias("mean_click_gap_s"),
        "max_scroll_depth",
        ratio(F.col("_scroll_cs"), F.col("_span"), 4).alias("scroll_time_share"),
        "typed_chars", "type_events", "distinct_targets", "url_revisits",
        ratio(F.col("n_actions") * 6000, F.col("_span"), 4).alias("actions_per_min"),
    )


FAST_GAP_S, MEDIUM_GAP_S = 2, 6


def policy_features(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Numeric and enum policy fields: target duration, rates, speed class, dominant action per third.

    ``sessions`` is ``(session_id, session_duration_s, n_actions)``.
    """
    third = F.floor((F.col("step") - 1) * 3 / F.col("n_actions")).cast("int")
    counts = (
        actions.join(sessions, "session_id").groupBy("session_id", third.alias("third"), "action")
        .agg(F.count(F.lit(1)).alias("n"), F.first("n_actions").alias("n_actions"), F.first("session_duration_s").alias("session_duration_s"))
    )

    def dominant(i: int) -> Column:
        here = F.when(F.col("third") == i, F.struct(-F.col("n"), F.col("action")))
        return F.min_by("action", here)

    def share(action: str) -> Column:
        return ratio(F.sum(F.when(F.col("action") == action, F.col("n")).otherwise(F.lit(0))), F.first("n_actions"), 3)

    gap = F.try_divide(F.first("session_duration_s"), F.first("n_actions") - 1)
    return counts.groupBy("session_id").agg(
        F.first("session_duration_s").alias("session_target_duration_s"),
        share("TYPE").alias("comment_probability"),
        share("API_CALL").alias("vote_probability"),
        F.when(gap < FAST_GAP_S, F.lit("fast")).when(gap < MEDIUM_GAP_S, F.lit("medium")).otherwise(F.lit("slow")).alias("browsing_speed"),
        dominant(0).alias("early_session"), dominant(1).alias("mid_session"), dominant(2).alias("late_session"),
    )
