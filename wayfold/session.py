"""Session helpers: a local builder for tests and reliable lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MOST_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wayfold")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares between executors.

    ``spark.checkpoint.dir`` names it.  Where that is unset, a local master
    (a test on one machine) gets a fresh temporary folder, remembered in the session; any other raises.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def small_batches(spark: SparkSession) -> None:
    """Python tasks of this session get Arrow batches of ``BATCH_BYTES`` at most, unless it asks for smaller ones.

    Spark fills a batch with 10,000 rows, which are tens of MB of texts: the executor's native memory and each Python
    worker hold some of them at once, and keep the room.  Rows and results are the same.
    """
    number, unit = re.fullmatch(r"(-?[0-9]+)\s*([kmgtp]?)i?b?", spark.conf.get(MOST_BYTES).strip().lower()).groups()
    bound = int(number) << (10 * " kmgtp".index(unit or " "))
    if not 0 < bound <= BATCH_BYTES:
        spark.conf.set(MOST_BYTES, str(BATCH_BYTES))


def materialize(df: DataFrame) -> DataFrame:
    """Write a stage table into the shared folder and continue from it.

    Lost executors then cost no recomputation of the stage, and later branches read only the
    columns they need.  The folder's owner decides how long stage tables are kept.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, column: str, values: list[str]) -> dict[str, DataFrame]:
    """Several stage tables from one run of ``df``: its rows by the value of ``column``, which is one of ``values``."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    return {v: read.filter(read[column] == v).drop(column) for v in values}
