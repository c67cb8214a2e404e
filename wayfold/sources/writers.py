"""Writers of parsed sessions, training files, reports and fitted models."""

from __future__ import annotations

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.catalogue import prefer_real
from wayfold.operators.sequence import paged
from wayfold.operators.training import as_messages


def parsed_documents(actions: DataFrame, headers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Nested session documents; a session longer than one page is several documents with rising ``page``."""
    fields = F.struct(*[c for c in actions.columns if c != "session_id"])
    pages = paged(actions, ["session_id"], "step", fields, "high_level_actions")
    profile = profiles.select("session_id", F.struct(*[c for c in profiles.columns if c != "session_id"]).alias("user_profile"))
    whole = headers.join(profile, "session_id", "left").join(pages, "session_id", "left")
    return whole.withColumns({"page": F.coalesce("page", F.lit(0)), "high_level_actions": F.coalesce("high_level_actions", F.array())})


def write_parsed(documents: DataFrame, path: str, mode: str = "append") -> None:
    documents.write.mode(mode).json(path)


def write_training(examples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines of chat messages per cluster and split; hot clusters are written by many tasks."""
    examples.select("cluster_id", "split", as_messages().alias("messages")).write.mode(mode).partitionBy("cluster_id", "split").json(path)


def write_report(reports: DataFrame, path: str, column: str, mode: str = "append") -> None:
    """Report texts or JSON documents with their keys."""
    reports.select("session_id", *[c for c in ("page", "generated_at") if c in reports.columns], column).write.mode(mode).json(path)


def latest_report(reports: DataFrame, column: str, order: str = "generated_at") -> DataFrame:
    """The newest report of each session."""
    return reports.groupBy("session_id").agg(F.max_by(column, order).alias(column), F.max(order).alias(order))


def save_model(model: KMeansModel, centroids: DataFrame, path: str, origin: str) -> None:
    """Stores the fitted model and its centroid table under ``path/origin``."""
    model.write().overwrite().save(f"{path}/{origin}/model")
    centroids.write.mode("overwrite").parquet(f"{path}/{origin}/centroids")


def load_centroids(spark: SparkSession, path: str, real: str = "real", old: str = "old") -> DataFrame:
    """Centroids of the preferred model: the real-data one when stored, else the older one."""
    schema = "cluster_id BIGINT, centroid ARRAY<DOUBLE>"

    def table(origin: str) -> DataFrame:
        # A glob that matches nothing would fail the read; the folder is asked for by name instead.
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
        names = [r["path"] for r in found.select("path").filter(F.col("path").contains(f"/{origin}/centroids/")).limit(1).collect()]
        return spark.read.schema(schema).parquet(f"{path}/{origin}/centroids") if names else spark.createDataFrame([], schema)

    return prefer_real(table(real), table(old))


def load_model(path: str, origin: str) -> KMeansModel:
    return KMeansModel.load(f"{path}/{origin}/model")
