"""Fixed schemas of the five fact tables and the dimensions."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, I, TS = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.TimestampType()


def _struct(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


# Arrival order: time of ingest, then file, place in the file (start of the
# block it was read in, then the row), then the place inside the payload.
INGEST_SEQ = _struct(("at", TS), ("file", S), ("block", L), ("row", L), ("rl", I), ("sl", I), ("rec", I))

COMMON = [
    ("id", L), ("ingest_seq", INGEST_SEQ), ("timestamp", TS), ("session_id", S), ("prompt_id", S),
    ("user_email", S), ("user_id", S), ("org_id", S),
]

API_REQUESTS = _struct(
    *COMMON,
    ("model", S), ("cost_usd", D), ("input_tokens", L), ("output_tokens", L),
    ("cache_read_tokens", L), ("cache_creation_tokens", L), ("duration_ms", L),
    ("app_version", S), ("terminal_type", S), ("response_content", S),
    ("source", S), ("aws_request_id", S),
)
TOOL_USES = _struct(*COMMON, ("tool_name", S), ("success", I), ("duration_ms", L), ("error", S))
USER_PROMPTS = _struct(*COMMON, ("prompt_length", L), ("prompt_content", S))
API_ERRORS = _struct(*COMMON, ("error_message", S), ("status_code", L), ("retries", L))
TOOL_DECISIONS = _struct(*COMMON, ("tool_name", S), ("decision", S))

FACTS = {
    "api_requests": API_REQUESTS,
    "tool_uses": TOOL_USES,
    "user_prompts": USER_PROMPTS,
    "api_errors": API_ERRORS,
    "tool_decisions": TOOL_DECISIONS,
}

# Hourly sums stored next to the facts (``timestamp`` is the start of the hour).
ROLLUPS = {
    "hourly_requests": _struct(
        ("timestamp", TS), ("user_email", S), ("session_id", S), ("model", S), ("source", S), ("requests", L), ("cost_usd", D),
        ("input_tokens", L), ("output_tokens", L), ("cache_read_tokens", L), ("cache_creation_tokens", L)),
    "hourly_prompts": _struct(("timestamp", TS), ("user_email", S), ("events", L)),
    "hourly_errors": _struct(("timestamp", TS), ("user_email", S), ("events", L)),
    "hourly_tools": _struct(("timestamp", TS), ("user_email", S), ("tool_name", S), ("uses", L), ("successes", L), ("failures", L),
                            ("duration_ms", L), ("timed", L)),
}
STORED = FACTS | ROLLUPS

ORG_MEMBERS = _struct(
    ("email", S), ("name", S), ("role", S), ("status", S), ("seat_tier", S),
    ("billing_model", S), ("imported_at", TS),
)
USER_ALIASES = _struct(("email", S), ("alias", S), ("created_at", TS))
TEAMS = _struct(("id", L), ("name", S), ("created_at", TS))
TEAM_MEMBERS = _struct(("team_id", L), ("user_email", S))
