"""Streaming jobs over several batches: restarts, counters and their batch twins."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from wayfold.operators import online as O
from wayfold.plans.q_streaming import StreamTables, stream_classify
from wayfold.plans.registry import Tables
from wayfold.streaming import jobs as J

SCHEMA = "session_id STRING, cluster_id BIGINT, processed_at TIMESTAMP"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def land(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drain(writer, checkpoint):
    J.start(writer, checkpoint, once=True).awaitTermination()


def test_dedupe_across_batches_and_reruns(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    land(spark, [("a", 1, at(0)), ("b", 1, at(0)), ("a", 1, at(1))], src)
    store = J.batches_to_table(out)
    fails = []

    def write(batch, batch_id):
        store(batch, batch_id)
        if fails:
            raise RuntimeError(fails.pop())

    def run():
        drain(J.dedupe_stream(spark.readStream.schema(SCHEMA).parquet(src)).writeStream.foreachBatch(write), ck)

    run()
    land(spark, [("b", 1, at(2)), ("c", 2, at(2)), (None, 2, at(2))], src)
    fails.append("lost after the batch was stored")
    with pytest.raises(Exception, match="lost after"):
        run()
    run()  # the batch is run again and replaces its own rows
    land(spark, [("c", 1, at(3)), (None, 1, at(3)), ("d", 2, at(3))], src)
    run()
    assert sorted(str(r.session_id) for r in spark.read.parquet(out).collect()) == ["None", "a", "b", "c", "d"]


def test_dedupe_looks_up_only_its_own_ids(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    land(spark, [(f"s{i}", 1, at(0)) for i in range(500)], src)
    stream = J.dedupe_stream(spark.readStream.schema(SCHEMA).parquet(src))
    read = []

    def run():
        query = J.start(stream.writeStream.foreachBatch(J.batches_to_table(out)), ck, once=True)
        query.awaitTermination()
        read.append(query.lastProgress)

    run()
    land(spark, [("s1", 1, at(1)), ("new", 1, at(1))], src)
    run()
    state = read[-1]["stateOperators"][0]
    assert state["numRowsTotal"] == 501 and state["numRowsUpdated"] == 1
    assert read[-1]["numInputRows"] == 2  # nothing of what earlier batches stored


def test_counts_reset_after_a_retrain(spark, tmp_path):
    out = str(tmp_path / "counts")
    jobs = []

    def retrains():
        return spark.createDataFrame(jobs, "job_id STRING, cluster_ids ARRAY<BIGINT>, triggered_at TIMESTAMP")

    write = J.count_to_table(out, retrains)
    first = [("a", 1, at(0)), ("b", 1, at(1)), ("c", 2, at(1))]
    write(spark.createDataFrame(first, SCHEMA), 0)
    now = lambda: {r.cluster_id: (r.new_sessions, r.ready) for r in J.current_counts(spark, out, retrains(), 2).collect()}
    assert now() == {1: (2, True), 2: (1, False)}
    jobs.append(("j1", [1], at(5)))
    assert now() == {2: (1, False)}
    later = [("d", 1, at(6)), ("e", 2, at(7))]
    write(spark.createDataFrame(later, SCHEMA), 1)
    write(spark.createDataFrame(later, SCHEMA), 1)
    assert now() == {1: (1, False), 2: (2, True)}
    batch = O.new_counts(spark.createDataFrame(first + later, SCHEMA), retrains())
    assert {r.cluster_id: r.new_sessions for r in batch.collect()} == {1: 1, 2: 2}


def test_webhook_stream_equals_table(spark, tmp_path):
    bodies = ['{"properties": {"$session_id": "a"}}', '{"properties": {"$session_recording_id": "", "session_id": "b"}}', '{"data": {"session_id": "c"}}', '{"event": "x"}', "not json"]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "b.jsonl").write_text("\n".join(bodies))
    done = spark.createDataFrame([("c",), ("c",)], "session_id STRING")
    stream = J.webhook_status(spark.readStream.text(str(tmp_path / "src")).withColumnRenamed("value", "body"), done)
    drain(stream.writeStream.format("json").option("path", str(tmp_path / "out")), str(tmp_path / "ck"))
    got = {r.body: r.status for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == dict(zip(bodies, ["accepted", "accepted", "skipped", "ignored", "ignored"]))


def test_stuck_stream_closes_on_gaps(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    times = [0, 10, 25, 41, 42]  # 15 s gaps are in time, 16 s is not
    rows = [("s", base + dt.timedelta(seconds=s)) for s in times] + [("late", base + dt.timedelta(seconds=200))]
    spark.createDataFrame(rows, "session_id STRING, ts TIMESTAMP").coalesce(1).write.parquet(str(tmp_path / "src"))
    stream = J.stuck_stream(spark.readStream.schema("session_id STRING, ts TIMESTAMP").parquet(str(tmp_path / "src")))
    drain(stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "ck"))
    got = sorted((r.session_id, (r.last_action - base).total_seconds(), r.actions) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("s", 25.0, 3), ("s", 42.0, 2)]


def test_stuck_clock_reports_each_pause_once(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "session_id STRING, ts TIMESTAMP"

    def come(*rows):
        spark.createDataFrame([(s, None if at_ is None else base + dt.timedelta(seconds=at_)) for s, at_ in rows], schema).coalesce(1).write.mode("append").parquet(src)

    def rows():
        return sorted((str(r.session_id), (r.last_action - base).total_seconds(), (r.stuck_at - r.last_action).total_seconds(), r.actions)
                      for r in spark.read.schema("session_id STRING, last_action TIMESTAMP, stuck_at TIMESTAMP, actions BIGINT").parquet(out).collect())

    def until(n):
        for _ in range(120):
            if query.exception():
                raise query.exception()
            if query.recentProgress and len(rows()) >= n:
                break
            time.sleep(0.5)
        return rows()

    come(("s", 0), ("s", 2), ("s", 5), ("s", 9), (None, 1), ("s", None))  # a pause of three seconds is in time, four is not
    writer = J.stuck_clock(spark.readStream.schema(schema).parquet(src), timeout_s=3).writeStream.format("parquet").option("path", out)
    query = J.start(writer, ck, every="1 second")
    try:
        gap = 3.000001
        first = [("None", 1.0, gap, 1), ("s", 5.0, gap, 3), ("s", 9.0, gap, 1)]
        assert until(3) == first  # the last pauses are reported although the stream is silent
        come(("s", 8), ("s", 30), ("s", 31), ("s", 40))
        assert until(5) == first + [("s", 31.0, gap, 2), ("s", 40.0, gap, 1)]
    finally:
        query.stop()


def test_model_is_fetched_again_only_when_a_new_one_is_published(spark, tmp_path):
    path = str(tmp_path / "model")
    labels = spark.createDataFrame([(1, "one")], "cluster_id BIGINT, label STRING")

    def centres(x):
        return spark.createDataFrame([(1, [x]), (2, [10.0])], "cluster_id BIGINT, centroid ARRAY<DOUBLE>")

    J.publish_model(centres(0.0), labels, path, 1)
    model = J.LatestModel(spark, path)
    write = J.classify_to_table(str(tmp_path / "rows"), model, at_least=1)
    batch = spark.createDataFrame([("a", 5, [6.0]), ("b", 5, [9.0]), ("c", 0, None), ("d", 5, None)], "session_id STRING, num_actions BIGINT, embedding ARRAY<DOUBLE>")
    write(batch, 0)
    held = model()
    assert model() is held and model.version == 1
    J.publish_model(centres(7.0), labels, path, 2)
    write(batch, 1)
    assert model() is not held and model.version == 2
    got = {(r.batch, r.session_id): (r.status, r.stage, r.cluster_id, r.cluster_label) for r in spark.read.parquet(str(tmp_path / "rows")).collect()}
    assert got[0, "a"][2] == 2 and got[1, "a"] == ("completed", "classify", 1, "one")
    assert got[1, "c"][:2] == ("failed", "parse") and got[1, "d"][:2] == ("failed", "embed")


def test_new_recordings_are_read_once(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()

    def recording(sid):
        doc = {"data": {"id": sid, "snapshots": [{"timestamp": 1, "type": 4, "data": {"href": "/"}}]}}
        (src / f"export-{sid}-ph-recording.json").write_text(json.dumps(doc))

    def run():
        drain(J.new_recordings(spark, str(src)).select("session_id", "file_session_id", F.size("snapshots").alias("n")).writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "ck"))

    recording("a")
    run()
    recording("b")
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", "a", 1), ("b", "b", 1)]


def test_bounded_dedupe(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    land(spark, [("a", 1, at(0)), ("a", 1, at(1)), ("b", 1, at(1))], src)
    stream = J.bounded_dedupe(spark.readStream.schema(SCHEMA).parquet(src), "session_id", "processed_at", "10 minutes")
    drain(stream.writeStream.outputMode("append").format("parquet").option("path", out), str(tmp_path / "ck"))
    assert sorted(r.session_id for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_retrain_admission(spark):
    requests = spark.createDataFrame([([1],), ([],)], "cluster_ids ARRAY<BIGINT>")
    history = spark.createDataFrame([("j", "completed")], "job_id STRING, status STRING")
    assert sorted(r.status for r in O.admit_retrain(requests, history).collect()) == ["no_data", "started"]
    running = spark.createDataFrame([("j", "fine_tuning")], "job_id STRING, status STRING")
    assert {r.status for r in O.admit_retrain(requests, running).collect()} == {"already_running"}


def test_streams_of_tables_that_are_one_file_or_folders_of_files(spark, tmp_path):
    vectors = [(i, i % 5, [float(i % 5), 1.0]) for i in range(1, 41)]
    spark.createDataFrame(vectors, "vec_id LONG, label LONG, embedding ARRAY<FLOAT>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(i, f"r{i}") for i in range(5)], "r_regionkey LONG, r_name STRING").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "region.parquet")
    rows = {r.session_id: (r.status, r.stage, r.cluster_id, r.cluster_label) for r in stream_classify(Tables(spark, str(tmp_path))).collect()}
    assert len(rows) == 40
    assert rows[3] == ("completed", "classify", 3, "r3") and rows[33] == ("failed", "embed", None, None) and rows[6] == ("failed", "parse", None, None)
    drain(StreamTables(spark, str(tmp_path)).region.writeStream.format("parquet").option("path", str(tmp_path / "copy")), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 5
