"""Flat-event sessions: rules, defaults and empty sessions."""

import json

from pyspark.sql import functions as F

from wayfold.operators import flat as FT
from wayfold.sources import readers as RD

EVENTS = [
    {"event_type": "page_load", "timestamp": 10_000, "url": "/home", "viewport_width": 1366.0, "viewport_height": 768.0},
    {"event_type": "mouse_move", "timestamp": 10_100, "x": 1, "y": 1},
    {"event_type": "click", "timestamp": 10_250, "x": 12.9, "y": None, "target_tag": "A", "target_text": "Go", "target_selector": ".nav.link"},
    {"event_type": "rage_click", "timestamp": 10_500, "x": 1, "y": 2, "target_text": None},
    {"event_type": "dead_click", "timestamp": 10_600, "x": 1, "y": 2, "target_text": "Buy"},
    {"event_type": "scroll", "timestamp": 11_000, "scroll_y": 300},
    {"event_type": "scroll", "timestamp": 11_500, "scroll_y": 300},
    {"event_type": "scroll", "timestamp": 12_000, "scroll_y": 120},
    {"event_type": "hover", "timestamp": 12_500, "hover_duration_ms": 640.4, "target_text": None},
    {"event_type": "hesitation", "timestamp": 13_000, "hover_duration_ms": 1500},
    {"event_type": "type", "timestamp": 13_500, "text": "hello"},
    {"event_type": "unheard_of", "timestamp": 13_600},
]


def load(spark, folder):
    (folder / "session_a.json").write_text(json.dumps({"id": "a", "duration_ms": 3650, "user_agent": "synthetic", "viewport_width": 1366, "events": EVENTS}, indent=1))
    (folder / "session_b.json").write_text(json.dumps({"id": "b", "duration_ms": 40, "events": []}))
    return RD.read_flat_sessions(spark, str(folder))


def test_actions(spark, tmp_path):
    events = RD.flat_events(load(spark, tmp_path))
    for frame in (events, events.orderBy(F.rand(3)).repartition(3)):
        rows = sorted(FT.normalize_flat_event(frame, ["seq"]).collect(), key=lambda r: r.step)
        assert [r.step for r in rows] == list(range(1, 11))
        assert [r.action for r in rows] == ["PAGE_LOAD", "CLICK", "CLICK", "CLICK", "SCROLL", "SCROLL", "SCROLL", "CLICK", "CLICK", "TYPE"]
        assert rows[0].viewport == "1366.0x768.0" and rows[0].time == 0.0
        assert (rows[1].target_class, rows[1].x, rows[1].y, rows[1].time) == ("nav.link", 12.0, 0.0, 0.25)
        assert [rows[i].target_text for i in (1, 2, 3, 7, 8)] == ["Go", "[RAGE CLICK]", "Buy [DEAD CLICK]", " [HOVER 640ms]", "[HESITATION 1500ms]"]
        assert [(r.scroll_from, r.scroll_to, r.max_depth, r.direction, r.duration_s) for r in rows[4:7]] == [
            (0, 300, 300, "down", 0.5), (300, 300, 300, "down", 0.5), (300, 120, 300, "up", 0.5)]
        assert (rows[8].target_tag, rows[9].target_tag, rows[9].text_length, rows[9].is_masked) == ("page", "input", 5, False)


def test_profile_defaults(spark, tmp_path):
    rows = {r.session_id: r for r in FT.flat_profile(load(spark, tmp_path)).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.browser, a.country, a.device_type, a.viewport_height, a.screen_width, a.session_duration_s, a.total_raw_events) == ("unknown", "unknown", "desktop", 1080.0, 1366.0, 3.7, 12)
    assert (b.browser, b.device_type, b.session_duration_s, b.total_raw_events) == (None, None, 0.0, 0)
