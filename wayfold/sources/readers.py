"""Readers with fixed schemas; identity comes from the file name where the content has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold import schemas
from wayfold.functions.text import is_json

# How stored files are named.
RECORDING_NAME = r"(?:export-)?(.+?)(?:-ph-recording)?\.json$"
DESCRIPTION_NAME = r"(?:description_)?(.+?)\.txt$"


def id_from_name(file_name: Column, pattern: str) -> Column:
    return F.regexp_extract(file_name, pattern, 1)


def _json(spark: SparkSession, path: str, schema: str, one_per_file: bool) -> DataFrame:
    """One document per file, or one per line where many small documents share a file."""
    return spark.read.schema(schema).option("multiLine", one_per_file).json(path)


def read_recordings(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Nested recordings, one row per document: ``session_id, version, person, snapshots, file_session_id``."""
    raw = _json(spark, path, schemas.RECORDING, one_per_file)
    return raw.select(
        F.col("data.id").alias("session_id"), "version", F.col("data.person").alias("person"), F.col("data.snapshots").alias("snapshots"),
        id_from_name(F.col("_metadata.file_name"), RECORDING_NAME).alias("file_session_id"))


def snapshot_line(line: Column) -> Column:
    """``[window_id, snapshot]`` or ``snapshot`` as a struct; null when the line is unreadable."""
    text = F.trim(line)
    readable = is_json(text)
    is_pair = text.startswith("[")
    body = F.when(is_pair, F.get_json_object(text, "$[1]")).otherwise(text)
    snap = F.from_json(body, "timestamp BIGINT, type INT, data STRING, windowId STRING")
    window = F.coalesce(snap["windowId"], F.when(is_pair, F.get_json_object(text, "$[0]")))
    filled = F.struct(*[snap[c].alias(c) for c in ("timestamp", "type", "data")], window.alias("windowId"))
    return F.when(readable & F.json_object_keys(body).isNotNull(), filled)


def parse_snapshot_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Readable snapshot lines as columns next to the others; blank and broken lines are dropped."""
    rest = [c for c in lines.columns if c != line]
    return lines.select(*rest, snapshot_line(F.col(line)).alias("_s")).filter(F.col("_s").isNotNull()).select(*rest, "_s.*")


def read_snapshot_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))
    return parse_snapshot_lines(lines)


def read_flat_sessions(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Flat-event sessions, one row per document, with ``event_count``."""
    raw = _json(spark, path, schemas.FLAT_SESSION, one_per_file)
    return raw.withColumnRenamed("id", "session_id").withColumn("event_count", F.coalesce(F.size("events"), F.lit(0)))


def flat_events(sessions: DataFrame) -> DataFrame:
    """Events of flat sessions in file order (``seq``)."""
    return sessions.select("session_id", F.posexplode("events").alias("seq", "_e")).select(
        "session_id", F.col("seq").cast("long").alias("seq"),
        *[F.col(f"_e.{c}").alias(c) for c in ("event_type", "timestamp", "x", "y", "target_selector", "target_tag", "target_text", "scroll_y", "hover_duration_ms",
                                             "viewport_width", "viewport_height", "url", "text", "text_length", "is_masked", "placeholder")])


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """One text per session."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(id_from_name(F.col("_metadata.file_name"), DESCRIPTION_NAME).alias("session_id"), F.col("value").alias("text"))


def parse_policies(texts: DataFrame, text: str = "value") -> DataFrame:
    """Policy JSON as columns; each step of ``action_sequence`` is a name, or an object that names its action."""
    rest = [c for c in texts.columns if c != text]
    parsed = texts.select(*rest, F.from_json(text, schemas.POLICY).alias("_p")).select(*rest, "_p.*")
    step = F.transform("action_sequence", lambda e: F.coalesce(F.get_json_object(e, "$.action"), e))
    return parsed.withColumn("action_sequence", step)


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select("value", F.regexp_extract("_metadata.file_name", r"(?:policy_)?(.+?)\.json$", 1).alias("session_id"))
    return parse_policies(raw)


def read_agent_logs(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Logged sessions, one row per document; sort by ``file_name`` descending for the latest first."""
    return _json(spark, path, schemas.AGENT_LOG, one_per_file).withColumn("file_name", F.col("_metadata.file_name"))


def agent_actions(logs: DataFrame) -> DataFrame:
    """Logged actions in order, 1-based ``step``."""
    rows = logs.select("session_id", F.posexplode("actions").alias("_p", "_a"))
    return rows.select("session_id", (F.col("_p") + 1).cast("long").alias("step"), "_a.*").withColumn(
        "skipped", F.coalesce(F.get_json_object("details", "$.skipped") == "true", F.lit(False)))


def agent_stuck_events(logs: DataFrame) -> DataFrame:
    return logs.select("session_id", F.explode("stuck_events").alias("_e")).select("session_id", "_e.*")


def agent_errors(logs: DataFrame) -> DataFrame:
    return logs.select("session_id", F.explode("errors").alias("_e")).select("session_id", "_e.*")


# Artifact folders and the step each one completes.
ARTIFACTS = {"recordings": "download", "parsed": "parse", "descriptions": "describe", "embeddings": "embed",
             "clusters": "cluster", "training": "training", "models": "finetune", "reports": "agents"}


def count_artifacts(paths: DataFrame, folder: Column, file_name: Column) -> DataFrame:
    """Files per expected folder (0 when missing) and whether its step is done; hidden files do not count."""
    spark = paths.sparkSession
    expected = spark.createDataFrame(list(ARTIFACTS.items()), "folder STRING, step STRING")
    counts = paths.filter(~file_name.startswith(".")).groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"))
    joined = expected.join(counts, "folder", "left")
    return joined.select("folder", "step", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce(F.col("files") > 0, F.lit(False)).alias("done"))


def inventory(spark: SparkSession, base: str) -> DataFrame:
    """Artifact counts below ``base``; only names are read, never contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path")
    parts = F.split("path", "/")
    return count_artifacts(files, F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1)))
