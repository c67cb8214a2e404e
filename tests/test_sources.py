"""Readers and writers over real files."""

import json

from pyspark.sql import functions as F

from wayfold.functions import html as H
from wayfold.functions import text as TX
from wayfold.operators import batches as BT
from wayfold.operators import kmeans as K
from wayfold.sources import readers as RD
from wayfold.sources import writers as WR


def test_snapshot_lines(spark, tmp_path):
    lines = ['["w1", {"timestamp": 5, "type": 4, "data": {"href": "/a"}}]', '["w2", {"timestamp": 6, "type": 3, "data": "raw", "windowId": "own"}]', "", "{broken", '{"timestamp": 7, "type": 2, "data": {}}',
             '{"timestamp": 8} {"timestamp": 9}', "[1]"]
    (tmp_path / "snap.jsonl").write_text("\n".join(lines))
    rows = sorted(RD.read_snapshot_lines(spark, str(tmp_path)).collect(), key=lambda r: r.timestamp)
    assert [(r.timestamp, r.type, r.windowId, r.data) for r in rows] == [(5, 4, "w1", '{"href":"/a"}'), (6, 3, "own", "raw"), (7, 2, None, "{}")]


def test_descriptions_policies_logs(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "description_s1.txt").write_text("line one\nline two")
    assert RD.read_descriptions(spark, str(tmp_path / "d")).collect() == [("s1", "line one\nline two")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "policy_s1.json").write_text(json.dumps({"navigation_style": "linear", "feed_behavior": {"max_posts_to_visit": 3}, "action_sequence": ["scan_feed", {"action": "open_post", "n": 1}]}, indent=2))
    policy = RD.read_policies(spark, str(tmp_path / "p")).first()
    assert policy.session_id == "s1" and policy.action_sequence == ["scan_feed", "open_post"] and policy.feed_behavior.max_posts_to_visit == 3
    (tmp_path / "l").mkdir()
    log = {"session_id": "s1", "start_time": 1.0, "total_duration_s": 9.5, "errors": [{"action": "login", "error": "no", "relative_s": 2}], "stuck_events": [{"action": "login", "reason": "Timeout", "relative_s": 3.5, "page_url": "/"}],
           "actions": [{"action_name": "login", "success": False, "error": "no", "details": {}}, {"action_name": "write_comment", "success": True, "details": {"skipped": True}}]}
    (tmp_path / "l" / "explore_1.json").write_text(json.dumps(log))
    logs = RD.read_agent_logs(spark, str(tmp_path / "l"))
    assert [(r.step, r.action_name, r.skipped) for r in RD.agent_actions(logs).collect()] == [(1, "login", False), (2, "write_comment", True)]
    assert RD.agent_stuck_events(logs).first().reason == "Timeout" and RD.agent_errors(logs).first().error == "no"


def test_inventory(spark, tmp_path):
    for name in ("parsed/a.json", "parsed/b.json", "parsed/.hidden", "models/m.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = {r.folder: (r.files, r.done) for r in RD.inventory(spark, str(tmp_path)).collect()}
    assert rows["parsed"] == (2, True) and rows["models"] == (1, True) and rows["training"] == (0, False) and len(rows) == len(RD.ARTIFACTS)


def test_parsed_documents_round_trip(spark, tmp_path):
    actions = spark.createDataFrame([("s", i, i / 2, "CLICK") for i in (3, 1, 2)], "session_id STRING, step BIGINT, time DOUBLE, action STRING")
    headers = spark.createDataFrame([("s", 1.5, 3), ("empty", 0.0, 0)], "session_id STRING, session_duration_s DOUBLE, total_raw_events BIGINT")
    profiles = spark.createDataFrame([("s", "x")], "session_id STRING, country STRING")
    WR.write_parsed(WR.parsed_documents(actions, headers, profiles), str(tmp_path / "out"))
    docs = {r.session_id: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert [a.step for a in docs["s"].high_level_actions] == [1, 2, 3] and docs["s"].user_profile.country == "x" and docs["empty"].high_level_actions == []


def test_training_and_reports_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", "S", "U", "A"), (1, "val", "S", "U2", "A"), (2, "val", "S", "U3", "A")], "cluster_id INT, split STRING, system STRING, user STRING, assistant STRING")
    WR.write_training(rows, str(tmp_path / "t"))
    back = spark.read.json(str(tmp_path / "t" / "cluster_id=1" / "split=val"))
    assert back.first().messages[1].content == "U2" and spark.read.json(str(tmp_path / "t")).count() == 3
    reports = spark.createDataFrame([("s", "2024-01-01", "old"), ("s", "2024-01-02", "new")], "session_id STRING, generated_at STRING, markdown STRING")
    WR.write_report(reports, str(tmp_path / "r"), "markdown")
    assert WR.latest_report(spark.read.json(str(tmp_path / "r")), "markdown").first().markdown == "new"


def test_models_prefer_real_data(spark, tmp_path):
    points = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "id BIGINT, embedding ARRAY<DOUBLE>")
    model = K.fit_kmeans(points, 2, starts=2)
    table = K.centroid_table(model, points)
    WR.save_model(model, table, str(tmp_path / "m"), "old")
    assert WR.load_centroids(spark, str(tmp_path / "m")).count() == 2
    WR.save_model(model, table.limit(1), str(tmp_path / "m"), "real")
    assert WR.load_centroids(spark, str(tmp_path / "m")).count() == 1
    assert len(WR.load_model(str(tmp_path / "m"), "old").clusterCenters()) == 2


def test_score_batches_retries_only_rate_limits(spark, tmp_path):
    waits = tmp_path / "waits"

    def model(text):
        if text == "busy":
            raise RuntimeError("429")
        if text == "bad":
            raise ValueError("broken")
        return text.upper()

    def sleep(seconds):
        with open(waits, "a") as f:
            f.write(f"{seconds}\n")

    df = spark.createDataFrame([("a", "ok"), ("b", "busy"), ("c", "bad"), ("d", "done")], "session_id STRING, text STRING")
    rows = {r.session_id: r for r in BT.score_batches(df, model, "text", done=df.filter("session_id = 'd'"), retries=3, concurrency=2, sleep=sleep).collect()}
    assert set(rows) == {"a", "b", "c"} and rows["a"].result == "OK"
    assert (rows["b"].error, rows["b"].attempts) == ("429", 3) and (rows["c"].error, rows["c"].attempts, rows["c"].result) == ("broken", 1, None)
    pauses = [float(x) for x in waits.read_text().split()]
    assert len(pauses) == 2 and 1 <= pauses[0] < 2 and 2 <= pauses[1] < 3


PAGE = """<html><head><title> A &amp; B </title><script>var x = "<a href='/no'>no</a>";</script></head><body>
<a class="l" href="/one"><b>One</b></a><a href='/two'>ONE</a><a>Three</a><button aria-label="Menu"></button><button>three</button><input type="submit" value="Send"/>
<form><input type="hidden" name="h"><input placeholder="Your name"><textarea name="msg"></textarea></form><h1>Top
line</h1><h2></h2><p>short</p><p>long enough text</p><li>long enough text</li></body></html>"""


def test_page_observation(spark):
    row = H.page_observation(spark.createDataFrame([("http://x/", PAGE)], "url STRING, html STRING")).first()
    assert row.title == "A & B" and row.forms == 1
    assert [(c.kind, c.text, c.href) for c in row.clickable] == [("link", "One", "/one"), ("link", "Three", ""), ("button", "Menu", ""), ("button", "Send", "")]
    assert [(i.type, i.label) for i in row.inputs] == [("submit", "submit"), ("text", "Your name"), ("text", "msg")]
    assert [(h.tag, h.text) for h in row.headings] == [("h1", "Top line")] and row.texts == ["long enough text"]
    assert row.observation.startswith("URL: http://x/\nTitle: A & B\n\nClickable") and row.observation.endswith("Forms: 1 visible")


def test_answers_and_targets(spark):
    df = spark.createDataFrame([('{"action": "click", "target": "x"}',), ('said {"action": "type"} ok',), ("nothing",), ('{"a": 1} {"action": "wait"}',)], "t STRING")
    assert [r[0].action for r in df.select(TX.parse_action_json(F.col("t"))).collect()] == ["click", "type", "scroll", None]
    targets = spark.createDataFrame([("down 300px",), ("UP 99999",), ("far",), ("up 12px",)], "t STRING")
    assert [tuple(r) for r in targets.select(TX.parse_scroll_target(F.col("t")), TX.parse_explore_scroll(F.col("t"))).collect()] == [(300, 300), (-2000, -400), (300, -400), (-12, -12)]
    fields = spark.createDataFrame([('"Title" : a: b',), ("plain",)], "t STRING")
    assert [tuple(r[0]) for r in fields.select(TX.split_type_target(F.col("t"))).collect()] == [("Title", "a: b"), ("plain", None)]


def test_files_of_one_row_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from wayfold.plans import q_sinks
    from wayfold.plans.registry import Tables

    for name, n in (("supplier", 1_001), ("nation", 7), ("region", 3)):
        spark.range(n).select("id").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(q_sinks, "_folder", lambda t: str(tmp_path / "out"))
    found = {r.folder: (r.files, r.done) for r in q_sinks.inventory_of_files(Tables(spark, str(tmp_path))).collect()}
    assert found["recordings"] == (1_001, True) and found["parsed"] == (7, True) and found["descriptions"] == (3, True) and found["models"] == (0, False)
    files = list((tmp_path / "out" / "recordings").glob("part-*.json"))
    assert sorted(json.loads(f.read_text())["id"] for f in files) == list(range(1_001))
    assert len({f.name.split("-")[1] for f in files}) == 5
