"""Fixed schemas of the nested inputs; every field is nullable and nothing is inferred."""

PROFILE_PROPERTIES = (
    "age_group: STRING, country: STRING, nyc_familiarity: STRING, `$os`: STRING, `$browser`: STRING, "
    "`$device_type`: STRING, `$viewport_width`: DOUBLE, `$viewport_height`: DOUBLE, "
    "`$screen_width`: DOUBLE, `$screen_height`: DOUBLE"
)

PERSON = f"properties STRUCT<{PROFILE_PROPERTIES}>"

RECORDING = (
    f"version STRING, data STRUCT<id: STRING, person: STRUCT<properties: STRUCT<{PROFILE_PROPERTIES}>>, "
    "snapshots: ARRAY<STRUCT<timestamp: BIGINT, type: INT, data: STRING, windowId: STRING>>>"
)

PAYLOAD = (
    "node STRING, href STRING, width STRING, height STRING, source INT, type INT, id BIGINT, "
    "x DOUBLE, y DOUBLE, text STRING, positions ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, "
    "adds ARRAY<STRUCT<node: STRING>>, "
    "payload STRUCT<requests: ARRAY<STRUCT<name: STRING, method: STRING>>>"
)

FLAT_EVENT = (
    "id: BIGINT, session_id: STRING, event_type: STRING, timestamp: DOUBLE, x: DOUBLE, y: DOUBLE, "
    "target_selector: STRING, target_tag: STRING, target_text: STRING, scroll_x: DOUBLE, scroll_y: DOUBLE, "
    "scroll_velocity: DOUBLE, hover_duration_ms: DOUBLE, viewport_width: DOUBLE, viewport_height: DOUBLE, "
    "url: STRING, text: STRING, text_length: BIGINT, is_masked: BOOLEAN, placeholder: STRING, extra: STRING"
)

FLAT_SESSION = (
    "id STRING, url STRING, viewport_width DOUBLE, viewport_height DOUBLE, user_agent STRING, "
    "started_at STRING, duration_ms DOUBLE, is_synthetic BOOLEAN, age_group STRING, country STRING, "
    f"device_type STRING, events ARRAY<STRUCT<{FLAT_EVENT}>>"
)

POLICY = (
    "session_target_duration_s DOUBLE, navigation_style STRING, browsing_speed STRING, "
    "feed_behavior STRUCT<initial_scroll_pattern: STRING, sort_preference: STRING, max_posts_to_visit: INT, "
    "scroll_between_posts: BOOLEAN>, "
    "post_interaction STRUCT<comment_probability: DOUBLE, vote_probability: DOUBLE, "
    "vote_then_comment_order: STRING, avg_comment_length_chars: INT, typing_speed: STRING, "
    "makes_typos: BOOLEAN, read_before_engaging_s: DOUBLE>, "
    "subreddit_exploration STRUCT<explores_subreddits: BOOLEAN, preferred_subreddits: ARRAY<STRING>, "
    "subreddit_browse_depth: STRING>, "
    "auth_behavior STRUCT<needs_auth: BOOLEAN, auth_method: STRING, auth_timing: STRING>, "
    "engagement_arc STRUCT<early_session: STRING, mid_session: STRING, late_session: STRING>, "
    "action_sequence ARRAY<STRING>"
)

AGENT_LOG = (
    "session_id STRING, start_time DOUBLE, total_duration_s DOUBLE, "
    "actions ARRAY<STRUCT<action_name: STRING, timestamp: DOUBLE, relative_s: DOUBLE, duration_s: DOUBLE, "
    "success: BOOLEAN, error: STRING, page_url: STRING, details: STRING>>, "
    "stuck_events ARRAY<STRUCT<action: STRING, reason: STRING, relative_s: DOUBLE, page_url: STRING>>, "
    "errors ARRAY<STRUCT<action: STRING, error: STRING, relative_s: DOUBLE>>"
)

ACTION_COLUMNS = {
    "session_id": "string", "step": "bigint", "time": "double", "action": "string",
    "target_tag": "string", "target_text": "string", "target_href": "string", "target_class": "string",
    "x": "double", "y": "double",
    "scroll_from": "bigint", "scroll_to": "bigint", "max_depth": "bigint", "duration_s": "double",
    "direction": "string",
    "text_length": "bigint", "is_masked": "boolean", "target_placeholder": "string",
    "path": "string", "full_path": "string", "url": "string", "viewport": "string",
}
"""The one action table both input formats end in; session_id keeps the caller's type."""
