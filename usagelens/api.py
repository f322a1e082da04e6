"""Public entry points, grouped as in the blueprint's operator inventory."""

from usagelens.functions import (  # noqa: F401
    arn_user, backfill_model_id, js_round, list_price, money_sum, normalize_model,
    to_int, to_num,
)
from usagelens.operators.aliases import alias_lookup, all_identities, assign_aliases, mask  # noqa: F401
from usagelens.operators.billing import (  # noqa: F401
    billing_by_user, billing_period, billing_summary, billing_totals, commitment_pool, commitment_status,
    enterprise_spend, join_roster, not_in_roster, seat_costs,
)
from usagelens.operators.feed import events_union, recent_events  # noqa: F401
from usagelens.operators.filters import (  # noqa: F401
    apply_filters, audience, in_period, known_only, resolve_audience, source_filter, time_range, unmask,
)
from usagelens.operators.report import reported_cost_by_user  # noqa: F401
from usagelens.operators.roster import (  # noqa: F401
    merge_roster, patch_roster, roster_listing, roster_with_telemetry, upserted_count, validate_patches,
)
from usagelens.operators.sessions import (  # noqa: F401
    session_conversation, session_timeline, session_timeline_tools, sessions,
)
from usagelens.operators.teams import apply_team_changes, team_rosters  # noqa: F401
from usagelens.operators.usage import (  # noqa: F401
    by_model, by_user, cost_over_time, hourly_activity, known_users, sample_rows, summary, tool_stats, top_model,
    user_model_breakdown,
)
from usagelens.operators.windows import (  # noqa: F401
    label_requests, per_user_windows, session_windows, usage_windows, weekly_windows, window_flags, window_summary,
)
from usagelens.sources.facts import align_schema, load_stored_tables, read_fact, write_facts  # noqa: F401
from usagelens.sources.invocations import (  # noqa: F401
    backfill_model_ids, dedup_by_request_id, invocation_window, invocations_to_requests, keep_invocations,
    new_ids_only, read_invocation_logs, sync_invocations, sync_stats,
)
from usagelens.sources.otlp import (  # noqa: F401
    attr_map, attribute_profile, canonical_event, event_name, flatten_otlp, flatten_records, identity_cols,
    ingest_counts, ingest_otlp, merge_attrs, missing_usage_report, nanos_to_ts, otlp_schema, quarantine, read_otlp, route,
    source_of, to_api_errors, to_api_requests, to_tool_decisions, to_tool_uses, to_user_prompts,
)
from usagelens.sources.roster_csv import parse_roster_lines, read_roster_csv  # noqa: F401
from usagelens.sources.usage_report import parse_usage_pages, read_usage_report  # noqa: F401
from usagelens.streaming.ingest import (  # noqa: F401
    read_aliases, read_quarantine, stream_ingest_invocations, stream_ingest_otlp, stream_otlp,
)
from usagelens.streaming.live import (  # noqa: F401
    read_daily_cost, read_usage_windows, stream_daily_cost, stream_usage_windows,
)
