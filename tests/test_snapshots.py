"""Recordings with the edge cases of the snapshot format."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from wayfold.operators import sequence
from wayfold.operators import snapshots as S
from wayfold.sources.readers import read_recordings


def node(i, tag="div", text="", children=(), **attrs):
    kids = list(children)
    if text:
        kids.append({"id": i + 900, "type": 3, "textContent": text, "childNodes": []})
    return {"id": i, "tagName": tag, "type": 2, "attributes": attrs, "childNodes": kids}


FULL = {"node": node(1, "html", children=[node(2, "body", children=[node(3, "a", "  Sign up  ", href="/signup", **{"class": "x" * 90})])])}
SNAPSHOTS = [
    (1000, 3, {"source": 2, "type": 2, "id": 3, "x": 1, "y": 2}),  # click before any definition
    (1100, 2, FULL),
    (1210, 4, {"href": "https://shop.app/home", "width": 1366, "height": 768}),
    (1300, 3, json.dumps({"source": 2, "type": 2, "id": 3, "x": 5, "y": 6})),  # payload as a JSON string
    (1400, 3, {"source": 3, "id": 1, "y": 10}),
    (1500, 3, {"source": 1, "positions": [{"x": 1, "y": 1}, {"x": 7, "y": 8}]}),  # does not break the scroll run
    (1650, 3, {"source": 3, "id": 1, "y": 90}),
    (1700, 3, {"source": 3, "id": 1, "y": 40}),
    (1800, 2, {"node": node(50, "div")}),  # a second full snapshot breaks the run and forgets nothing
    (1900, 3, {"source": 3, "id": 1, "y": 40}),
    (2000, 3, {"source": 0, "adds": [{"node": node(3, "button", "Buy")}]}),  # redefinition
    (2100, 3, gzip.compress(json.dumps({"source": 2, "type": 2, "id": 3, "x": 9, "y": 9}).encode()).decode("latin-1")),
    (2200, 3, {"source": 5, "id": 77, "text": "****"}),
    (2300, 3, {"source": 5, "id": 3, "text": "ab*"}),
    (2350, 3, {"source": 5, "id": 3, "text": ""}),
    (2400, 6, {"payload": {"requests": [{"name": "https://x.app/api/posts?p=1", "method": "POST"}, {"name": "/static/a.js"}, {"name": "/api/raw?x"}]}}),
    (2500, 3, "{broken"),
    (2600, 3, {"source": 1}),  # no positions
    (2700, 3, {"source": 2, "type": 1, "id": 3}),  # mouse up
    (2655, 3, '{"source": 3} trailing'),
]


def write_recording(folder, name="rec", sid="s1"):
    doc = {"version": "1", "data": {"id": sid, "person": {"properties": {"age_group": "25-34", "$os": "Linux", "$viewport_width": 1366}},
                                    "snapshots": [{"timestamp": t, "type": k, "data": d} for t, k, d in SNAPSHOTS]}}
    (folder / f"export-{name}-ph-recording.json").write_text(json.dumps(doc), encoding="utf-8")


@pytest.mark.parametrize("segment_rows", [1, 3, 100_000])
def test_recording_end_to_end(spark, tmp_path, monkeypatch, segment_rows):
    """Also with segments so short that every value has to be inherited from earlier ones."""
    monkeypatch.setattr(sequence, "LEAST_ROWS", segment_rows)
    write_recording(tmp_path)
    recordings = read_recordings(spark, str(tmp_path))
    assert recordings.first().file_session_id == "rec"
    actions, headers = S.parse_recordings(recordings)
    rows = sorted(actions.collect(), key=lambda r: r.step)
    assert [r.action for r in rows] == ["CLICK", "PAGE_LOAD", "CLICK", "SCROLL", "SCROLL", "CLICK", "TYPE", "TYPE", "API_CALL", "API_CALL"]
    assert [r.time for r in rows] == [0.0, 0.21, 0.3, 0.4, 0.9, 1.1, 1.2, 1.3, 1.4, 1.4]
    assert [r.target_tag for r in rows if r.action == "CLICK"] == ["unknown", "a", "button"]
    assert (rows[2].target_text, rows[2].target_href, rows[2].target_class) == ("Sign up", "/signup", "x" * 60)
    run, single = rows[3], rows[4]
    assert (run.scroll_from, run.scroll_to, run.max_depth, run.duration_s, run.direction) == (10, 40, 90, 0.3, "down")
    assert (single.scroll_from, single.scroll_to, single.duration_s, single.direction) == (40, 40, 0.0, "up")
    assert [(r.text_length, r.is_masked, r.target_tag) for r in rows if r.action == "TYPE"] == [(4, True, "unknown"), (3, False, "button")]
    assert [(r.path, r.full_path) for r in rows if r.action == "API_CALL"] == [("/api/posts", "/api/posts?p=1"), ("/api/raw", "/api/raw?x")]
    assert rows[1].viewport == "1366x768"
    header = headers.first()
    # The last snapshot in file order decides, although it is not the latest.
    assert header.session_duration_s == 1.66 and header.total_raw_events == 15
    profile = S.user_profile(recordings).first()
    assert (profile.age_group, profile.os, profile.viewport_width, profile.country) == ("25-34", "Linux", 1366.0, None)


def test_row_order_does_not_matter(spark, tmp_path):
    write_recording(tmp_path)
    snaps = S.explode_snapshots(read_recordings(spark, str(tmp_path)))
    fields = S.with_fields(S.decode_payload(snaps))
    shuffled = S.with_fields(S.decode_payload(snaps.orderBy(F.rand(1)).repartition(5)))

    def resolved(f):
        refs = S.typed_events(f).filter(F.col("event_type").isin("CLICK", "INPUT"))
        return sorted((r.seq, r.tag) for r in S.resolve_node(refs, S.flatten_dom(f)).collect())

    assert resolved(fields) == resolved(shuffled) == [(0, "unknown"), (3, "a"), (11, "button"), (12, "unknown"), (13, "button")]


def test_dom_depth_and_last_visit(spark):
    df = spark.createDataFrame([("s", 0, 2, json.dumps({"node": node(1, "a", children=[node(2, "b"), node(1, "c", "late")])}))], "session_id STRING, seq BIGINT, type INT, payload STRING")
    rows = {r.node_id: r for r in S.flatten_dom(S.with_fields(df)).collect()}
    assert (rows[1].tag, rows[1].depth, rows[1].text) == ("c", 1, "late") and rows[2].depth == 1


def test_parts_continue_the_position(spark):
    part = [(i, 3, "{}") for i in range(3)]
    df = spark.createDataFrame([("s", 0, part), ("s", 1, part)], "session_id STRING, part BIGINT, snapshots ARRAY<STRUCT<timestamp: BIGINT, type: INT, data: STRING>>")
    assert sorted(r.seq for r in S.explode_snapshots(df, "part").collect()) == [0, 1, 2, 1000, 1001, 1002]


def test_a_part_that_is_too_long_is_refused(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_ROWS", 2)
    df = spark.createDataFrame([("s", 0, [(i, 3, "{}") for i in range(3)])], "session_id STRING, part BIGINT, snapshots ARRAY<STRUCT<timestamp: BIGINT, type: INT, data: STRING>>")
    with pytest.raises(Exception, match="at most 2 snapshots, not 3"):
        S.explode_snapshots(df, "part").collect()
    assert S.explode_snapshots(df).count() == 3


def test_one_scan_gives_what_separate_passes_give(spark, tmp_path):
    write_recording(tmp_path)
    recordings = read_recordings(spark, str(tmp_path))
    fields = S.with_fields(S.decode_payload(S.explode_snapshots(recordings)))
    parsed = S.parsed_tables(recordings)
    for one, other in ((parsed.events, S.typed_events(fields)), (parsed.nodes, S.flatten_dom(fields)), (parsed.times, S.explode_snapshots(recordings).select("session_id", "seq", "ts_ms"))):
        assert one.columns == other.columns
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_odd_payloads_parse_as_they_decode(spark):
    texts = ["x", '{"source":1} junk', '{"source":1', "[1]", '"s"', "null", None, "", " {\"source\":3} ", '{"source":1},{"source":2}', '{"source":1}]', '{"source":"a","type":2}', '{"positions":[{"x":1,"y":"q"}],"source":1}', '[{"source":1}]', "{}"]
    df = spark.createDataFrame([("s", i, 3, t) for i, t in enumerate(texts)], "session_id STRING, seq BIGINT, type INT, data STRING")
    strict = {r.seq: r.j or "{}" for r in S.with_payload(df).select("seq", F.to_json("p").alias("j")).collect()}
    assert strict == {r.seq: r.j for r in S.with_fields(S.decode_payload(df)).select("seq", F.to_json("p").alias("j")).collect()}


def test_deep_dom_is_walked(spark):
    # Deeper than recursive queries allow by default.
    tree = node(300, "leaf")
    for i in range(299, 100, -1):
        tree = node(i, "div", children=[tree])
    text = json.dumps({"node": tree})
    df = spark.createDataFrame([("s", 0, 2, text)], "session_id STRING, seq BIGINT, type INT, payload STRING")
    assert S.flatten_dom(S.with_fields(df)).agg(F.max("depth")).first()[0] == 199


def test_odd_nodes_do_not_end_the_walk():
    from wayfold.operators.snapshots import _walk

    roots = ['"abc"', "{broken", '{"id": 1, "attributes": {"placeholder": true, "href": 7}, "childNodes": [3, {"id": "x"}, {"id": 2, "tagName": "p", "attributes": []}]}', None]
    found = {n["node_id"]: n for n in _walk(roots)}
    assert set(found) == {1, 2} and found[1]["placeholder"] == "true" and found[1]["href"] == "7" and found[2]["tag"] == "p"
