"""Structured Streaming jobs of the online path.

Per-batch results are written under ``batch=<id>`` and replaced when a batch is run again, so a
restart after a lost executor or driver repeats nothing.  What is remembered for each key is keyed
state in RocksDB, which a batch asks for its own keys only; what is counted is a table of counts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.functions.text import extract_id
from wayfold.functions.vectors import nearest_centroid
from wayfold.operators.agent import STUCK_TIMEOUT_S
from wayfold.operators.clusters import attach_cluster_label
from wayfold.operators.filters import MIN_ACTIONS_ONLINE
from wayfold.operators.online import last_retrains
from wayfold.schemas import RECORDING
from wayfold.sources.readers import RECORDING_NAME, id_from_name

POLL = "60 seconds"
PREVIEW_CHARS = 200


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Queries started from now on keep their state in RocksDB: on disk, with only its changes written per batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def new_recordings(spark: SparkSession, path: str, max_files: int = 1_000, one_per_file: bool = True) -> DataFrame:
    """Recordings as they land in a folder, each file once; one document per file, or one per line."""
    raw = spark.readStream.schema(RECORDING).option("multiLine", one_per_file).option("maxFilesPerTrigger", max_files).json(path)
    return raw.select(F.col("data.id").alias("session_id"), F.col("data.person").alias("person"), F.col("data.snapshots").alias("snapshots"),
                      id_from_name(F.col("_metadata.file_name"), RECORDING_NAME).alias("file_session_id"))


def start(writer: DataStreamWriter, checkpoint: str, once: bool = False, every: str = POLL) -> StreamingQuery:
    """Starts a job that polls, or one that takes what is there and stops."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def stop_when_idle(polling: StreamingQuery, pause_s: float = 0.2) -> None:
    """Stops a polling job after its first batch without new rows; one that waits for timers never ends by itself."""
    try:
        while polling.isActive and not (polling.lastProgress and polling.lastProgress["numInputRows"] == 0):
            time.sleep(pause_s)
        if polling.exception():
            raise polling.exception()
    finally:
        polling.stop()


def _replace(batch: DataFrame, path: str, batch_id: int) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _table(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of earlier batches; empty while nothing was written yet."""
    options = spark.read.schema(f"{schema}, batch BIGINT").option("ignoreMissingFiles", True)
    try:
        rows = options.parquet(path)
    except Exception as error:  # noqa: BLE001 - Spark names the missing path in the message
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], f"{schema}, batch BIGINT")
    return rows if before is None else rows.filter(F.col("batch") < before)


def dedupe_stream(stream: DataFrame, id_: str = "session_id") -> DataFrame:
    """The first row of each id over the whole life of the stream.

    Ids seen are keyed state, parted by their hash: a batch looks up its own ids, and no batch reads the history.
    The state of a batch is committed with the batch, so that one that failed is decided again alike.
    """
    keyed_state(stream.sparkSession)
    return stream.dropDuplicates([id_])


def batches_to_table(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: stores each batch, and replaces it when it is run again."""
    def write(batch: DataFrame, batch_id: int) -> None:
        _replace(batch, path, batch_id)

    return write


def bounded_dedupe(stream: DataFrame, id_: str, time: str, horizon: str) -> DataFrame:
    """First row per id among those at most ``horizon`` apart; state is dropped behind the watermark."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark([id_])


def classify_rows(batch: DataFrame, centroids: DataFrame, labels: DataFrame, at_least: int = MIN_ACTIONS_ONLINE) -> DataFrame:
    """Outcome of each session: the failing stage, or its cluster; nothing is raised.

    Input is ``session_id, num_actions, embedding``, a null embedding meaning that stage failed; with a
    ``description`` its start is kept.
    """
    text = F.col("description") if "description" in batch.columns else F.lit("")
    batch = batch.withColumns({
        "description_preview": F.substring(text, 1, PREVIEW_CHARS), "embedding_dim": F.coalesce(F.size("embedding"), F.lit(0)).cast("long"),
        "processed_at": F.current_timestamp()})
    record = ["session_id", "num_actions", "description_preview", "embedding_dim", "processed_at"]
    stage = F.when(F.col("num_actions") < at_least, F.lit("parse")).when(F.col("embedding").isNull(), F.lit("embed"))
    judged = batch.withColumn("stage", stage)
    too_few = F.concat(F.lit("Too few actions ("), F.col("num_actions").cast("string"), F.lit("), skipping"))
    failed = judged.filter(F.col("stage").isNotNull()).select(
        *record, F.lit("failed").alias("status"), "stage",
        F.when(F.col("stage") == "parse", too_few).otherwise(F.lit("no embedding")).alias("error"))
    placed = nearest_centroid(judged.filter(F.col("stage").isNull()), centroids)
    done = attach_cluster_label(placed, labels).select(
        *record, F.lit("completed").alias("status"), F.lit("classify").alias("stage"), "cluster_id", "cluster_label", "distance")
    return done.unionByName(failed, allowMissingColumns=True)


MODEL = "cluster_id BIGINT, centroid ARRAY<DOUBLE>, label STRING"


def publish_model(centroids: DataFrame, labels: DataFrame, path: str, version: int) -> None:
    """Stores a model version (centroids with their labels); it counts once its number is listed, which comes last."""
    rows = centroids.join(labels, "cluster_id", "left").selectExpr("CAST(cluster_id AS BIGINT) AS cluster_id", "CAST(centroid AS ARRAY<DOUBLE>) AS centroid", "label")
    rows.write.mode("overwrite").parquet(f"{path}/versions/{version}")
    centroids.sparkSession.createDataFrame([(version,)], "version BIGINT").coalesce(1).write.mode("append").parquet(f"{path}/published")


class LatestModel:
    """The newest published model of a folder: each batch asks for its number, only a new one is fetched."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path
        self.version: int | None = None
        self._rows: DataFrame | None = None

    def __call__(self) -> DataFrame:
        newest = self._spark.read.schema("version BIGINT").parquet(f"{self._path}/published").agg(F.max("version")).first()[0]
        if newest != self.version:
            self._rows = self._spark.read.schema(MODEL).parquet(f"{self._path}/versions/{newest}")
            self.version = newest
        return self._rows


def classify_to_table(path: str, model: Callable[[], DataFrame], at_least: int = MIN_ACTIONS_ONLINE) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: outcomes by the model that ``model()`` names for the batch (``LatestModel``)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = model()
        labels = rows.filter(F.col("label").isNotNull()).select("cluster_id", "label")
        _replace(classify_rows(batch, rows.select("cluster_id", "centroid"), labels, at_least), path, batch_id)

    return write


COUNTS = "cluster_id BIGINT, last_retrain TIMESTAMP, n BIGINT"


def count_to_table(path: str, retrains: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Counts new sessions per cluster and batch, next to the retrain that was the latest at the time.

    ``retrains`` re-reads the job table for every batch.  Sessions reach it in order of arrival, each
    once (after ``dedupe_to_table``).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        latest = last_retrains(retrains())
        rows = batch.join(latest, "cluster_id", "left").filter(F.col("last_retrain").isNull() | (F.col("processed_at") > F.col("last_retrain")))
        counts = rows.groupBy("cluster_id", "last_retrain").agg(F.count(F.lit(1)).alias("n"))
        typed = counts.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("last_retrain").cast("timestamp").alias("last_retrain"), "n")
        _replace(typed, path, batch_id)

    return write


def current_counts(spark: SparkSession, path: str, retrains: DataFrame, threshold: int) -> DataFrame:
    """``(cluster_id, new_sessions, ready)`` now: batches counted before the latest retrain no longer add."""
    latest = last_retrains(retrains).select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("last_retrain").cast("timestamp").alias("_now"))
    valid = _table(spark, path, COUNTS).join(latest, "cluster_id", "left").filter(F.col("last_retrain").eqNullSafe(F.col("_now")))
    summed = valid.groupBy("cluster_id").agg(F.sum("n").alias("new_sessions"))
    return summed.withColumn("ready", F.col("new_sessions") >= threshold)


def webhook_status(payloads: DataFrame, processed: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``recording_id`` and ``status`` (ignored, skipped, accepted); works on a stream and on a table."""
    known = processed.select(F.col("session_id").alias("recording_id")).distinct().withColumn("_known", F.lit(True))
    named = payloads.withColumn("recording_id", extract_id(F.col(body)))
    return named.join(known, "recording_id", "left").withColumn(
        "status", F.when(F.col("recording_id").isNull(), F.lit("ignored")).when(F.col("_known"), F.lit("skipped")).otherwise(F.lit("accepted"))
    ).drop("_known")


def stuck_stream(actions: DataFrame, time: str = "ts", timeout_s: int = STUCK_TIMEOUT_S, lateness: str = "1 minute") -> DataFrame:
    """A row whenever no action follows within the timeout: ``(session_id, last_action, stuck_at, actions)``.

    A gap-based event-time window closes exactly then.  It is one microsecond wider than the timeout
    because an action at the very end of the timeout still counts as in time.
    """
    gap = f"{timeout_s} seconds 1 microsecond"
    return (
        actions.withWatermark(time, lateness)
        .groupBy("session_id", F.session_window(time, gap).alias("w"))
        .agg(F.max(time).alias("last_action"), F.count(F.lit(1)).alias("actions"))
        .select("session_id", "last_action", F.col("w.end").alias("stuck_at"), "actions")
    )


PAUSES = "session_id STRING, last_action TIMESTAMP, stuck_at TIMESTAMP, actions BIGINT"
#: Latest action of a session, actions since the last pause, and whether the clock has reported the pause after it.
LATEST = "last BIGINT, actions BIGINT, told BOOLEAN"


def _pauses(timeout_s: int) -> Callable:
    gap = timeout_s * 1_000_000

    def rows(key: tuple, found: list[tuple[int, int]]) -> pd.DataFrame:
        last = np.array([f[0] for f in found], np.int64)
        return pd.DataFrame({
            "session_id": pd.Series([key[0]] * len(found), dtype=object), "last_action": pd.to_datetime(last, unit="us"),
            "stuck_at": pd.to_datetime(last + gap + 1, unit="us"), "actions": [f[1] for f in found]})

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, actions, _ = state.get
            state.update((last, actions, True))
            yield rows(key, [(last, actions)])
            return
        times = np.sort(np.concatenate([batch["us"].to_numpy(np.int64) for batch in batches]))
        last, actions, told = state.get if state.exists else (None, 0, False)
        found = []
        if last is not None:
            late, times = int((times <= last).sum()), times[times > last]
            actions += late
            if len(times):
                if told or times[0] - last > gap:
                    if not told:
                        found.append((last, actions))
                    actions = 0
                told = False
        if len(times):
            runs = np.split(times, np.flatnonzero(np.diff(times) > gap) + 1)
            for part in runs[:-1]:
                found.append((int(part[-1]), actions + len(part)))
                actions = 0
            last, actions = int(runs[-1][-1]), actions + len(runs[-1])
        state.update((last, actions, told))
        if not told:
            state.setTimeoutDuration(gap // 1000)
        if found:
            yield rows(key, found)

    return run


def stuck_clock(actions: DataFrame, at: str = "ts", timeout_s: int = STUCK_TIMEOUT_S) -> DataFrame:
    """``stuck_stream`` that needs no later action: ``(session_id, last_action, stuck_at, actions)``.

    A pause between two actions is reported when the second one comes, and one at the end when the clock has gone on
    for the time-out since the latest action arrived; each pause once, and the first action after a report of the
    clock begins anew.  Actions that come late count for the pause that is open.  Rows without a time are left out; a
    null id is a session.  A batch holds eight bytes for each new action of a session while it sorts them.  Started
    with ``once`` such a job would wait for its timers for ever; let it poll, and stop it (``stop_when_idle``).
    """
    keyed_state(actions.sparkSession)
    kind = actions.schema["session_id"].dataType
    # Ids pass as text: pandas has no whole numbers with nulls.
    rows = actions.filter(F.col(at).isNotNull()).select(F.col("session_id").cast("string").alias("session_id"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    found = rows.groupBy("session_id").applyInPandasWithState(_pauses(timeout_s), PAUSES, LATEST, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return found.withColumn("session_id", F.col("session_id").cast(kind))
