"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a document draws an exponential clock ``-ln(u) / weight`` for every child and descends into the
one that rings first.  Shards added after the installed tree have a clock of their own beside the regions, so
no other clock changes: rows move only into an added shard, whichever rack it stands in.  A document draws
regions + racks of one region + shards of one rack + additions, not once for every shard.

Defined results: a null id is a key like any other; null text counts 16 bytes and the checksum of the empty
text; rows alike get neighbouring slots; slots run gapless from 0 in each shard; empty input, empty output.
Slots come from counts per (shard, hash bucket): only a bucket is ordered, never a shard, and rows alike are
counted before the shuffle and unfolded afterwards, so a repeated document is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import seeded_hash, seeded_hash_sql

SEED = 7
SHARDS = 40
REGIONS, RACKS, PER_RACK = 4, 2, 5
#: Hash buckets a shard's slots are counted in.
BUCKETS = 8192
_FULL = float(2**60)


def clock(doc_id: Column, node: Column, weight: Column) -> Column:
    """When the node's clock rings for a document; heavier nodes ring earlier."""
    return -F.log((seeded_hash(SEED, doc_id, node) + F.lit(1)) / F.lit(_FULL)) / weight


def _first(doc_id: Column, nodes: list[tuple[str, int, float]]) -> Column:
    """The id of the node that rings first; nodes are (name, id, weight)."""
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for n, i, w in nodes])
    return F.array_min(F.transform(table, lambda x: F.struct(clock(doc_id, x["n"], x["w"]).alias("t"), x["i"].alias("i"))))["i"]


def with_shards(docs: DataFrame, name: str, added: list[float] = (), regions: int = REGIONS, racks: int = RACKS, per_rack: int = PER_RACK) -> DataFrame:
    """Adds column ``name``: the shard of ``doc_id`` in the installed tree plus shards of the weights ``added``."""
    key, installed = F.col("doc_id"), regions * racks * per_rack
    tops = [(f"region{r}", r, racks * per_rack) for r in range(regions)] + [(f"added{i}", regions + i, w) for i, w in enumerate(added)]
    top, rack = f"{name}_top", f"{name}_rack"
    out = docs.withColumn(top, _first(key, tops))

    def child(stem: str, parent: Column, count: int) -> Column:
        ids = F.sequence(F.lit(0), F.lit(count - 1))
        return F.array_min(F.transform(ids, lambda k: F.struct(clock(key, F.concat(F.lit(stem), k.cast("string"), F.lit("-of-"), parent.cast("string")), F.lit(1.0)).alias("t"), k.alias("k"))))["k"]

    out = out.withColumn(rack, F.col(top) * racks + child("rack", F.col(top), racks))
    shard = F.col(rack) * per_rack + child("shard", F.col(rack), per_rack)
    return out.withColumn(name, F.when(F.col(top) < regions, shard).otherwise(F.col(top) - regions + installed).cast("int")).drop(top, rack)


def shard_documents(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    alike = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    alike = with_shards(with_shards(alike, "shard"), "grown_shard", [1.0])
    alike = alike.withColumn("h", seeded_hash(SEED, F.col("doc_id"))).withColumn("bucket", F.col("h") % BUCKETS)
    upto = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = alike.groupBy("shard", "bucket").agg(F.sum("n").alias("n_bucket")).select("shard", "bucket", F.coalesce(F.sum("n_bucket").over(upto), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["shard", "bucket"])
    placed = placed.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("before") + F.col("turn")).alias("slot"), "grown_shard")


def _draw(node: str, weight: str = "1.0") -> str:
    return f"-ln(({seeded_hash_sql(SEED, 'doc_id', node)} + 1) / {_FULL!r}) / {weight}"


#: DuckDB twin without the checksum, which DuckDB has no function for.
SHARD_SQL = f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, {seeded_hash_sql(SEED, "doc_id")} AS h FROM documents),
tops AS (SELECT doc_id, t.i, {_draw("t.n", "t.w")} AS c FROM (SELECT DISTINCT doc_id FROM d), (SELECT 'region' || range AS n, range AS i, 10.0 AS w FROM range(4) UNION ALL SELECT 'added0', 4, 1.0) t),
top AS (SELECT doc_id, arg_min(i, c) FILTER (WHERE i < 4) AS r, arg_min(i, c) AS g FROM tops GROUP BY doc_id),
rack AS (SELECT doc_id, any_value(g) AS g, any_value(r) * 2 + arg_min(k, {_draw("'rack' || k || '-of-' || r")}) AS rk FROM top, (SELECT range AS k FROM range(2)) GROUP BY doc_id),
leaf AS (SELECT doc_id, any_value(g) AS g, any_value(rk) * 5 + arg_min(k, {_draw("'shard' || k || '-of-' || rk")}) AS s FROM rack, (SELECT range AS k FROM range(5)) GROUP BY doc_id)
SELECT d.doc_id, d.size, 'key' AS law, CAST(s AS INTEGER) AS shard, row_number() OVER (PARTITION BY s ORDER BY h % {BUCKETS}, h, d.doc_id, size) - 1 AS slot, CAST(CASE WHEN g < 4 THEN s ELSE 40 END AS INTEGER) AS grown_shard
FROM d JOIN leaf ON d.doc_id IS NOT DISTINCT FROM leaf.doc_id
"""
