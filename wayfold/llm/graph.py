"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: every node of ``edges`` (columns ``a, b``) with the least node it is connected to.

    Each round is two aggregations with map-side combination; rounds are written to the shared folder.  Only
    whether a round left stars alone reaches the driver.
    """
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    while not _stars_alone(now):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(down, "b")
        small = joined.select(F.col("m").alias("a"), "b").unionByName(joined.filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a < b").distinct()
        now = materialize(small)
    return now.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root").unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _stars_alone(edges: DataFrame) -> bool:
    """Whether no node has two lesser neighbours, or a lesser and a greater one."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("a").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 AND up > 0").isEmpty()


class Rooted:
    """Components of links that come bit by bit: earlier links are kept as stars, and nothing runs where none is new."""

    def __init__(self) -> None:
        self._near: DataFrame | None = None

    def add(self, links: DataFrame) -> None:
        if self._near is None:
            self._near = materialize(components(links))
        elif not links.isEmpty():
            stars = self._near.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
            self._near = materialize(components(stars.unionByName(links.select("a", "b"))))

    def name(self, rows: DataFrame) -> DataFrame:
        """``rows`` (``id``) with the ``root`` of each."""
        return rows.join(self._near.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
