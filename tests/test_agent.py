"""Agent logs: streaks, comparison formulas, scores and friction."""

import json

import pytest
from pyspark.sql import functions as F

from wayfold.functions import text as TX
from wayfold.operators import agent as A
from wayfold.operators import scoring as SC
from wayfold.operators.reports import markdown_report, report_json

SCHEMA = "session_id STRING, step BIGINT, action_name STRING, relative_s DOUBLE, duration_s DOUBLE, success BOOLEAN, error STRING, page_url STRING, target STRING, skipped BOOLEAN, action STRING"


def log(spark, outcomes, sid="s", names=None):
    rows = [(sid, i, (names or ["open_post"])[(i - 1) % len(names or [1])], 2.0 * i, 1.0 + i / 100, ok, "" if ok else f"e{i}", "/p", f"t{i}", False, "click") for i, ok in enumerate(outcomes, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def reference_streaks(outcomes, limit=3):
    count, out = 0, []
    for ok in outcomes:
        count = 0 if ok else count + 1
        out.append(count)
        if count >= limit:
            count = 0
    return out


@pytest.mark.parametrize("run", [1, 3, 4, 6, 7])
def test_streak_restarts_after_three(spark, run):
    outcomes = [True] + [False] * run + [True, False]
    rows = sorted(A.error_streak(log(spark, outcomes)).collect(), key=lambda r: r.step)
    assert [r.streak for r in rows] == reference_streaks(outcomes)
    assert [r.recovery for r in rows] == [s == 3 for s in reference_streaks(outcomes)]


def test_error_context_is_dropped_by_recovery(spark):
    outcomes = [False, True, False, False, False, True]
    rows = sorted(A.error_context(A.error_streak(log(spark, outcomes))).collect(), key=lambda r: r.step)
    assert [r.error_context for r in rows] == ["", "e1", "", "e3", "e4", ""]


def test_completion_ratio(spark):
    summary = spark.createDataFrame([("s", 18, 18, 0, 82.33, 0, 0, 1.0)], "session_id STRING, total_actions BIGINT, successful_actions BIGINT, failed_actions BIGINT, total_duration_s DOUBLE, stuck_events BIGINT, error_count BIGINT, completion_rate DOUBLE")
    planned = spark.createDataFrame([("s", 18)], "session_id STRING, planned_actions BIGINT")
    real = spark.createDataFrame([("s", 105.16)], "session_id STRING, real_user_duration_s DOUBLE")
    assert A.completion_block(summary, planned, real).first().duration_ratio == 0.78
    assert A.completion_block(summary, planned, real.withColumn("real_user_duration_s", F.lit(0.0))).first().duration_ratio == 0.0


def test_timing_delta(spark):
    agent = spark.createDataFrame([("s", "scan_feed", 1.17), ("s", "login", 2.0)], "session_id STRING, action_name STRING, agent_avg_s DOUBLE")
    real = spark.createDataFrame([("s", "scan_feed", 0.19), ("s", "open_post", 1.0)], "session_id STRING, action_name STRING, real_user_avg_s DOUBLE")
    rows = A.timing_deltas(agent, real).collect()
    assert [(r.action_name, r.delta_s, r.ratio) for r in rows] == [("scan_feed", 0.98, 6.16)]


def test_real_timings_skip_the_first_and_zero_gaps(spark):
    rows = [("s", 1, 0.0, "PAGE_LOAD"), ("s", 2, 1.0, "CLICK"), ("s", 3, 1.0, "CLICK"), ("s", 4, 2.5, "CLICK"), ("s", 5, 3.0, "API_CALL"), ("s", 6, 5.0, "TYPE")]
    got = {r.action_name: r.real_user_avg_s for r in A.real_action_timings(spark.createDataFrame(rows, "session_id STRING, step BIGINT, time DOUBLE, action STRING")).collect()}
    assert got == {"open_post": 1.5, "write_comment": 2.0}


def test_positional_match(spark):
    schema = "session_id STRING, pos BIGINT, action STRING"
    planned = spark.createDataFrame([("s", i, a) for i, a in enumerate("abcd", 1)], schema)
    actual = spark.createDataFrame([("s", i, a) for i, a in enumerate("abxde", 1)] + [("t", 1, "a")], schema)
    rows = {r.session_id: r for r in A.positional_match(planned, actual).collect()}
    assert (rows["s"].sequential_matches, rows["s"].match_rate, rows["s"].deviation_score, rows["s"].actual_length) == (3, 0.75, 0.25, 5)
    assert rows["t"].match_rate is None and rows["t"].deviation_score == 0.0
    kinds = {(r.difference, r.action) for r in A.sequence_differences(planned, actual).collect() if r.session_id == "s"}
    assert kinds == {("missing", "c"), ("extra", "x"), ("extra", "e")}


def test_stuck_needs_more_than_the_timeout(spark):
    rows = [("s", 1, "a", 0.0), ("s", 2, "a", 15.0), ("s", 3, "a", 30.01)]
    df = spark.createDataFrame(rows, "session_id STRING, step BIGINT, action_name STRING, relative_s DOUBLE")
    assert [(r.step, r.gap_s) for r in A.stuck_points(df).collect()] == [(3, 15.01)]


def test_impressions_and_scores(spark):
    rows = log(spark, [True, False, True, True, True])
    felt = A.impressions(rows)
    assert sorted((r.step, r.sentiment) for r in felt.collect()) == [(2, "frustration"), (5, "neutral"), (5, "summary")]
    facts = SC.run_all_scorers(SC.session_facts(rows, felt)).first()
    assert facts.exploration_coverage.success_rate == 0.8 and facts.exploration_coverage.coverage_score == 1.0
    assert facts.friction_detection.friction_density == 0.4
    assert facts.session_completeness.completeness_score == 0.5 and facts.session_completeness.has_session_summary
    pace = 5 / 10.0 * 60
    assert facts.demographic_consistency.actions_per_minute == pace and facts.demographic_consistency.consistency_score == 0.68


def test_friction_tiers(spark):
    rows = log(spark, [True, False], names=["open_post", "login"])
    deltas = spark.createDataFrame([("s", "open_post", 3.2)], "session_id STRING, action_name STRING, ratio DOUBLE")
    items = {r.action_name: r for r in SC.friction_items(rows, deltas).collect()}
    assert (items["login"].score, items["login"].severity) == (55, "critical") and len(items["login"].reasons) == 2
    assert (items["open_post"].score, items["open_post"].severity) == (15, "medium")
    assert items["open_post"].reasons == ["3.2x slower than real user — moderate friction"]
    heat = {r.action_name: r.intensity for r in SC.heat_intensity(SC.friction_items(rows, deltas)).collect()}
    assert heat == {"login": 1.0, "open_post": 0.273}


def test_action_label(spark):
    cases = [("signup", '{"username": "ann"}', "Signed up as ann"), ("write_comment", '{"skipped": true}', "Comment skipped (probability)"), ("write_comment", "{}", "Wrote comment (? chars)"),
             ("scan_feed", "{}", "Scanned feed (default)"), ("other", "{}", "other"), ("open_post", '{"post_title": "x"}', 'Opened "x"')]
    df = spark.createDataFrame([(n, d) for n, d, _ in cases], "n STRING, d STRING")
    assert [r[0] for r in df.select(A.action_label(F.col("n"), F.col("d"))).collect()] == [e for _, _, e in cases]


def test_log_without_actions_or_plan_still_reports(spark):
    rows = log(spark, [True, True])
    summary = A.session_summary(rows)
    none = spark.createDataFrame([], "session_id STRING, planned_actions BIGINT")
    real = spark.createDataFrame([], "session_id STRING, real_user_duration_s DOUBLE")
    completion = A.completion_block(summary, none, real)
    empty = spark.createDataFrame([], "session_id STRING, pos BIGINT, action STRING")
    did = spark.createDataFrame([("s", 1, "a")], "session_id STRING, pos BIGINT, action STRING")
    deviation, differences = A.positional_match(empty, did), A.sequence_differences(empty, did)
    feedback = spark.createDataFrame([("s", None, "Too slow.")], "session_id STRING, generated_at STRING, feedback STRING")
    deltas = spark.createDataFrame([], "session_id STRING, action_name STRING, agent_avg_s DOUBLE, real_user_avg_s DOUBLE, delta_s DOUBLE, ratio DOUBLE")
    text = markdown_report(completion, deltas, A.top_errors(rows), A.stuck_points(rows), deviation, differences, feedback).first().markdown
    assert "| Planned actions | 0 |" in text and "- **Match rate:** N/A" in text
    assert "**Generated:** unknown" in text and "- **Extra actions:** a" in text and "Missing actions" not in text and text.endswith("## Qualitative Feedback\n\nToo slow.")
    engagement = A.engagement_counts(spark.createDataFrame([("s", "CLICK")], "session_id STRING, action STRING"), rows)
    stuck = spark.createDataFrame([("s", 1, "a", 2.0, "no button"), ("s", 2, "b", 3.0, None)], "session_id STRING, step BIGINT, action_name STRING, relative_s DOUBLE, reason STRING")
    report = json.loads(report_json(completion, deltas, A.top_errors(rows), stuck, deviation, differences, engagement).first().report)
    assert [x["reason"] for x in report["errors"]["stuck_details"]] == ["no button", "Timeout"]
    assert report["deviation"]["extra_action_types"] == ["a"] and report["engagement"]["real_user_click_events"] == 1


def test_sections_are_cut_at_headings(spark):
    cases = [
        ("", {}), (None, {}), ("## 1. friction   POINTS\nslow\n## 3. Flow Problems x\n y\n### Details\nz", {"Friction Points": "slow", "Flow Problems": "x\n y\n### Details\nz"}),
        ("### **5. Specific Recommendations (ranked)**\n- a\n### Key Takeaway\nact", {"Specific Recommendations": "- a", "Key Takeaway": "act"}),
        ("### 2. Friction Points\nno\n### 2. Accessibility Issues\nyes", {"Accessibility Issues": "yes"}), ("# 1. Friction Points\none mark is no heading", {}),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i INT, t STRING")
    found = df.select("i", *[c.alias(k) for k, c in TX.markdown_sections(F.col("t")).items()]).collect()
    for r in found:
        assert {k: v for k, v in r.asDict().items() if k != "i" and v is not None} == cases[r.i][1]
