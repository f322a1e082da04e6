"""The registered queries: each takes (spark, sf_dir) and returns a
DataFrame over the fixture tables derived from the driver's parquet."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.operators import feed, filters, sessions, usage, windows
from usagelens.params import Filters
from usagelens.plans.output import stable
from usagelens.session import ensure_checkpoint_dir
from usagelens.sources import fixtures

ALL = Filters()
# Parameters of the filter queries (fixed values).
RANGE = Filters(from_="2024-01-05T00:00:00", to="2024-01-20T00:00:00")
AUDIENCE = Filters(users=("user1@example.com", " user5@example.com ", "", "USER-3"), teams=(1,), masked=True)
AUDIENCE_CLEAR = Filters(users=("user1@example.com", "user5@example.com", "USER-3"), teams=(2,))
NOBODY = Filters(users=("nobody@example.com",))
SOURCE_CC = Filters(source="claude_code")
SOURCE_BEDROCK = Filters(source="bedrock")
MIXED = Filters(from_="2024-01-03", to="2024-01-28T12:00:00", teams=(1, 2), source="opencode")

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
A_SESSION = "s_4_2024-01-24"   # has entries of two prompts in every table size
# Stored (not computed) doubles: passed through unrounded, as the oracle does.
RAW = ("cost_usd",)


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _t(spark, sf_dir):
    return fixtures.load_tables(spark, sf_dir)


def usage_tables(**tables):
    from usagelens.params import Tables

    return Tables(**{n: tables.get(n) for n in ("api_requests", "tool_uses", "user_prompts", "api_errors", "tool_decisions")})


def _placed(df):
    """A sorted result with each row's place. A sorted result lies in ranges, one
    per partition: the place is the rank within the range, which the running id
    holds, plus the rows of the ranges before it. No task sees all rows."""
    from pyspark.sql import Window

    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.withColumn("_at", F.monotonically_increasing_id()).checkpoint(eager=True)
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: a tiny single-partition window.
    offsets = (ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
               .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    at = F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.join(F.broadcast(offsets), "_range").select(at.cast("int").alias("place"), *df.columns)


# ── flat aggregates ─────────────────────────────────────────────────────────
@register("summary")
def q_summary(spark, sf_dir):
    return stable(usage.summary(spark, _t(spark, sf_dir), ALL))


@register("summary_filtered")
def q_summary_filtered(spark, sf_dir):
    return stable(usage.summary(spark, _t(spark, sf_dir), MIXED))


@register("cost_over_time")
def q_cost_over_time(spark, sf_dir):
    return stable(usage.cost_over_time(spark, _t(spark, sf_dir), ALL))


@register("by_model")
def q_by_model(spark, sf_dir):
    return stable(usage.by_model(spark, _t(spark, sf_dir), ALL))


@register("by_model_source_claude_code")
def q_by_model_cc(spark, sf_dir):
    return stable(usage.by_model(spark, _t(spark, sf_dir), SOURCE_CC))


@register("user_model_breakdown")
def q_umb(spark, sf_dir):
    return stable(usage.user_model_breakdown(spark, _t(spark, sf_dir), ALL))


@register("top_model")
def q_top_model(spark, sf_dir):
    return stable(usage.top_model(spark, _t(spark, sf_dir), ALL))


@register("by_user")
def q_by_user(spark, sf_dir):
    return stable(usage.by_user(spark, _t(spark, sf_dir), ALL, nested=False))


@register("by_user_models")
def q_by_user_models(spark, sf_dir):
    """The nested per-user model list, flattened to one row per entry
    with its position (arrays are compared as rows)."""
    b = usage.by_user(spark, _t(spark, sf_dir), ALL, nested=True)
    e = b.select("user_email", F.posexplode("models").alias("pos", "m"))
    return stable(e.select("user_email", "pos", F.col("m.model").alias("model"), F.col("m.requests").alias("requests"),
                           F.col("m.cost").alias("cost"), F.col("m.total_tokens").alias("total_tokens")))


@register("by_user_masked")
def q_by_user_masked(spark, sf_dir):
    return stable(usage.by_user(spark, _t(spark, sf_dir), Filters(masked=True), nested=False))


@register("by_model_order")
def q_by_model_order(spark, sf_dir):
    return _placed(usage.by_model(spark, _t(spark, sf_dir), ALL)).select("place", "model")


@register("cost_over_time_order")
def q_cot_order(spark, sf_dir):
    return _placed(usage.cost_over_time(spark, _t(spark, sf_dir), ALL)).select("place", "day")


@register("known_users_masked_order")
def q_known_users_order(spark, sf_dir):
    return _placed(usage.known_users(spark, _t(spark, sf_dir), masked=True))


@register("tool_stats")
def q_tool_stats(spark, sf_dir):
    return stable(usage.tool_stats(spark, _t(spark, sf_dir), ALL))


@register("tool_stats_filtered")
def q_tool_stats_f(spark, sf_dir):
    return stable(usage.tool_stats(spark, _t(spark, sf_dir), MIXED))


@register("hourly_activity")
def q_hourly(spark, sf_dir):
    return stable(usage.hourly_activity(spark, _t(spark, sf_dir), ALL))


@register("known_users")
def q_known_users(spark, sf_dir):
    return usage.known_users(spark, _t(spark, sf_dir))


@register("known_users_masked")
def q_known_users_masked(spark, sf_dir):
    return usage.known_users(spark, _t(spark, sf_dir), masked=True)


@register("sample_rows")
def q_sample_rows(spark, sf_dir):
    return stable(usage.sample_rows(spark, _t(spark, sf_dir)), keep=RAW)


# ── filters (the filtered rows themselves) ──────────────────────────────────
def _rows(df):
    return stable(df.select("id", "timestamp", "user_email", "source", "cost_usd"), keep=RAW)


@register("filter_time_range")
def q_f_time(spark, sf_dir):
    t = _t(spark, sf_dir)
    return _rows(filters.time_range(t.api_requests, RANGE.from_, RANGE.to))


@register("filter_audience")
def q_f_aud(spark, sf_dir):
    t = _t(spark, sf_dir)
    return _rows(filters.audience(t.api_requests, filters.resolve_audience(spark, t, AUDIENCE_CLEAR)))


@register("filter_audience_nobody")
def q_f_nobody(spark, sf_dir):
    t = _t(spark, sf_dir)
    return _rows(filters.audience(t.api_requests, filters.resolve_audience(spark, t, NOBODY)))


@register("filter_audience_blank")
def q_f_blank(spark, sf_dir):
    """A list of blank users is an audience of nobody."""
    t = _t(spark, sf_dir)
    return _rows(filters.audience(t.api_requests, filters.resolve_audience(spark, t, Filters(users=(" ", "")))))


@register("filter_audience_unknown_team")
def q_f_unknown_team(spark, sf_dir):
    t = _t(spark, sf_dir)
    return _rows(filters.audience(t.api_requests, filters.resolve_audience(spark, t, Filters(teams=(999,)))))


@register("resolve_audience")
def q_resolve(spark, sf_dir):
    t = _t(spark, sf_dir)
    return filters.resolve_audience(spark, t, AUDIENCE)


@register("filter_source_claude_code")
def q_f_src_cc(spark, sf_dir):
    return _rows(filters.source_filter(_t(spark, sf_dir).api_requests, "claude_code"))


@register("filter_source_bedrock")
def q_f_src_b(spark, sf_dir):
    return _rows(filters.source_filter(_t(spark, sf_dir).api_requests, "bedrock"))


@register("filter_in_period")
def q_f_period(spark, sf_dir):
    return _rows(filters.in_period(_t(spark, sf_dir).api_requests, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 15)))


@register("filter_known_only")
def q_f_known(spark, sf_dir):
    return _rows(filters.known_only(_t(spark, sf_dir).api_requests))


@register("filter_combined")
def q_f_mixed(spark, sf_dir):
    t = _t(spark, sf_dir)
    return _rows(filters.apply_filters(spark, t.api_requests, t, MIXED))


# ── gap windows ─────────────────────────────────────────────────────────────
@register("session_windows")
def q_session_windows(spark, sf_dir):
    return stable(windows.session_windows(spark, _t(spark, sf_dir), ALL))


@register("session_windows_filtered")
def q_session_windows_f(spark, sf_dir):
    return stable(windows.session_windows(spark, _t(spark, sf_dir), MIXED))


@register("usage_windows")
def q_usage_windows(spark, sf_dir):
    t = _t(spark, sf_dir)
    return stable(windows.usage_windows(t.api_requests, windows.SESSION_GAP_SECONDS))


@register("weekly_windows")
def q_weekly_windows(spark, sf_dir):
    t = _t(spark, sf_dir)
    return stable(windows.weekly_windows(spark, t, ALL, requests=t.extra["sparse_requests"]))


@register("weekly_windows_events")
def q_weekly_windows_ev(spark, sf_dir):
    return stable(windows.weekly_windows(spark, _t(spark, sf_dir), ALL))


@register("window_summary")
def q_window_summary(spark, sf_dir):
    return stable(windows.window_summary(windows.session_windows(spark, _t(spark, sf_dir), ALL, ordered=False)))


@register("window_summary_weekly")
def q_window_summary_w(spark, sf_dir):
    t = _t(spark, sf_dir)
    return stable(windows.window_summary(windows.weekly_windows(spark, t, ALL, requests=t.extra["sparse_requests"],
                                                                ordered=False)))


# ── sessions, feed, timeline ────────────────────────────────────────────────
@register("sessions")
def q_sessions(spark, sf_dir):
    return stable(sessions.sessions(spark, _t(spark, sf_dir), ALL))


@register("sessions_all")
def q_sessions_all(spark, sf_dir):
    return stable(sessions.sessions(spark, _t(spark, sf_dir), ALL, limit=None))


@register("recent_events")
def q_recent(spark, sf_dir):
    return stable(feed.recent_events(spark, _t(spark, sf_dir), ALL), keep=RAW)


@register("recent_events_audience")
def q_recent_aud(spark, sf_dir):
    return stable(feed.recent_events(spark, _t(spark, sf_dir), AUDIENCE_CLEAR, limit=200), keep=RAW)


@register("events_union")
def q_events_union(spark, sf_dir):
    return stable(feed.events_union(spark, _t(spark, sf_dir), ALL), keep=RAW)


@register("session_timeline")
def q_timeline(spark, sf_dir):
    return stable(sessions.session_timeline(_t(spark, sf_dir), nested=False))


@register("session_timeline_tools")
def q_timeline_tools(spark, sf_dir):
    return stable(sessions.session_timeline_tools(_t(spark, sf_dir)))


# ── OTLP ingest round trip ──────────────────────────────────────────────────
_OTLP: dict = {}


def _otlp_records(spark, sf_dir):
    """Derived payloads -> records -> routed tables, built once per session."""
    from usagelens.sources import otlp

    from usagelens.plans import landed

    key = (fixtures.session_key(spark), sf_dir)
    if key not in _OTLP:
        path = landed.otlp_payload_dir(spark, sf_dir)
        records = otlp.read_otlp(spark, path, fixtures.AS_OF)
        _OTLP[key] = (records, otlp.route(records))
    return _OTLP[key][0]


def _otlp_routed(spark, sf_dir):
    _otlp_records(spark, sf_dir)
    return _OTLP[(fixtures.session_key(spark), sf_dir)][1]


def _otlp_table(name):
    def q(spark, sf_dir):
        return stable(_otlp_routed(spark, sf_dir)[name].drop("id", "ingest_seq"), keep=RAW)
    q.__name__ = f"q_otlp_{name}"
    return q


for _name in ("api_requests", "tool_uses", "user_prompts", "api_errors", "tool_decisions"):
    register(f"otlp_{_name}")(_otlp_table(_name))


@register("otlp_ingest_counts")
def q_otlp_counts(spark, sf_dir):
    from usagelens.sources import otlp

    return otlp.ingest_counts(_otlp_records(spark, sf_dir))


@register("otlp_missing_usage")
def q_otlp_missing(spark, sf_dir):
    from usagelens.sources import otlp

    return otlp.missing_usage_report(_otlp_records(spark, sf_dir))


@register("otlp_attribute_profile")
def q_otlp_profile(spark, sf_dir):
    from usagelens.sources import otlp

    return otlp.attribute_profile(_otlp_records(spark, sf_dir))


@register("otlp_quarantine")
def q_otlp_quarantine(spark, sf_dir):
    """Rejects by reason, with the text of those that are no JSON."""
    from usagelens.sources import otlp

    q = otlp.quarantined(_otlp_records(spark, sf_dir))
    text = F.when(F.col("reason") == otlp.BAD_JSON, F.col("payload"))
    return q.groupBy("reason", text.alias("payload")).agg(F.count(F.lit(1)).alias("records"))


@register("otlp_record_keys")
def q_otlp_keys(spark, sf_dir):
    """Every record has its own id, and its place in the payload."""
    r = _otlp_records(spark, sf_dir).filter(F.coalesce(F.col("reason") != "invalid JSON", F.lit(True)))
    return r.groupBy(F.col("ingest_pos.rl_pos").alias("rl_pos"), F.col("ingest_pos.rec_pos").alias("rec_pos")).agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("id").alias("ids"))


# ── billing ─────────────────────────────────────────────────────────────────
PLAN15 = fixtures.PlanConfig(billing_cycle_day=15, commitment_amount_usd=2000, commitment_discount_pct=25)


@register("billing_by_user")
def q_billing_by_user(spark, sf_dir):
    from usagelens.operators import billing

    return stable(billing.billing_by_user(spark, _t(spark, sf_dir), fixtures.PLAN, fixtures.AS_OF))


@register("billing_by_user_cycle15_masked")
def q_billing_by_user15(spark, sf_dir):
    from usagelens.operators import billing

    return stable(billing.billing_by_user(spark, _t(spark, sf_dir), PLAN15, fixtures.AS_OF, masked=True))


@register("billing_totals")
def q_billing_totals(spark, sf_dir):
    from usagelens.operators import billing

    return stable(billing.billing_totals(billing.billing_by_user(spark, _t(spark, sf_dir), fixtures.PLAN, fixtures.AS_OF)))


@register("commitment_status")
def q_commitment(spark, sf_dir):
    from usagelens.operators import billing

    return stable(billing.commitment_status(_t(spark, sf_dir), fixtures.PLAN, fixtures.AS_OF))


@register("commitment_status_period_fallback")
def q_commitment15(spark, sf_dir):
    from usagelens.operators import billing

    return stable(billing.commitment_status(_t(spark, sf_dir), PLAN15, fixtures.AS_OF))


@register("billing_summary")
def q_billing_summary(spark, sf_dir):
    """The billing view's parts as rows: period, seat prices, totals, users, pacing."""
    from usagelens.operators import billing

    b = billing.billing_summary(spark, _t(spark, sf_dir), fixtures.PLAN, fixtures.AS_OF)
    row = lambda part, value: (F.lit(part).alias("part"), F.round(value.cast("double"), 6).alias("value"))
    p, out = b["billing_period"], []
    for c in ("days_elapsed", "days_remaining", "total_days"):
        out.append(p.select(*row(c, F.col(c))))
    for c in ("start", "end"):
        out.append(p.select(*row(c, F.unix_seconds(c))))
    totals = b["totals"]
    out += [totals.select(*row(c, F.col(c))) for c in totals.columns]
    for name, value in b["seat_costs"].items():
        out.append(totals.select(*row(name, F.lit(float(value)))))
    out.append(b["by_user"].agg(F.count(F.lit(1)).alias("n")).select(*row("users", F.col("n"))))
    out.append(b["commitment"].select(*row("commitment_consumed", F.col("consumed"))))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows


@register("join_roster")
def q_join_roster(spark, sf_dir):
    from usagelens.operators import billing

    t = _t(spark, sf_dir)
    return billing.join_roster(t.api_requests, t.org_members).select(
        "id", "user_email", "name", "seat_tier", "billing_model")


@register("enterprise_spend")
def q_enterprise_spend(spark, sf_dir):
    from usagelens.operators import billing

    t = _t(spark, sf_dir)
    return stable(billing.enterprise_spend(t.api_requests, t.org_members, dt.datetime(2024, 1, 1),
                                           dt.datetime(2024, 1, 15)).select("id", "user_email", "cost_usd"), keep=RAW)


@register("not_in_roster")
def q_not_in_roster(spark, sf_dir):
    from usagelens.operators import billing

    t = _t(spark, sf_dir)
    return billing.not_in_roster(t.api_requests, t.org_members)


# ── roster, teams, aliases ──────────────────────────────────────────────────
@register("roster_with_telemetry")
def q_roster_tele(spark, sf_dir):
    from usagelens.operators import roster

    t = _t(spark, sf_dir)
    return stable(roster.roster_with_telemetry(t.api_requests, t.org_members))


@register("roster_with_telemetry_masked")
def q_roster_tele_m(spark, sf_dir):
    from usagelens.operators import roster

    t = _t(spark, sf_dir)
    return stable(roster.roster_with_telemetry(t.api_requests, t.org_members, t.user_aliases, masked=True))


@register("roster_csv_merge")
def q_roster_merge(spark, sf_dir):
    from usagelens.operators import roster
    from usagelens.plans import landed
    from usagelens.sources import roster_csv

    t = _t(spark, sf_dir)
    rows = roster_csv.read_roster_csv(spark, landed.roster_csv_dir(spark, sf_dir))
    return stable(roster.merge_roster(t.org_members, rows, fixtures.AS_OF))


@register("roster_csv_rows")
def q_roster_rows(spark, sf_dir):
    from usagelens.plans import landed
    from usagelens.sources import roster_csv

    return roster_csv.read_roster_csv(spark, landed.roster_csv_dir(spark, sf_dir)).drop("file", "line")


@register("roster_upserted_count")
def q_roster_upserted(spark, sf_dir):
    from usagelens.operators import roster
    from usagelens.plans import landed
    from usagelens.sources import roster_csv

    return roster.upserted_count(roster_csv.read_roster_csv(spark, landed.roster_csv_dir(spark, sf_dir)))


@register("roster_listing")
def q_roster_listing(spark, sf_dir):
    from usagelens.operators import roster

    return stable(_placed(roster.roster_listing(_t(spark, sf_dir).org_members)))


@register("patch_roster")
def q_patch(spark, sf_dir):
    from usagelens.operators import roster
    from usagelens.plans import derived

    from usagelens.plans import landed

    t = _t(spark, sf_dir)
    patches = derived.roster_patches(t, landed.identities(spark, sf_dir))
    return stable(roster.patch_roster(t.org_members, patches, fixtures.AS_OF, t.user_aliases))


@register("patch_roster_rejects")
def q_patch_rejects(spark, sf_dir):
    from usagelens.operators import roster
    from usagelens.plans import derived

    from usagelens.plans import landed

    _, bad = roster.validate_patches(derived.roster_patches(_t(spark, sf_dir), landed.identities(spark, sf_dir)))
    return bad.select("seq", "email", "reason")


@register("team_changes")
def q_team_changes(spark, sf_dir):
    from usagelens.operators import teams
    from usagelens.plans import derived

    from usagelens.plans import landed

    t = _t(spark, sf_dir)
    changes = derived.team_changes(t, landed.identities(spark, sf_dir))
    _, members = teams.apply_team_changes(t.teams, t.team_members, changes, t.user_aliases)
    return members


@register("team_changes_teams")
def q_team_changes_teams(spark, sf_dir):
    from usagelens.operators import teams
    from usagelens.plans import derived

    from usagelens.plans import landed

    t = _t(spark, sf_dir)
    changes = derived.team_changes(t, landed.identities(spark, sf_dir))
    tm, _ = teams.apply_team_changes(t.teams, t.team_members, changes, t.user_aliases)
    return tm.select("id", "name")


@register("team_rosters")
def q_team_rosters(spark, sf_dir):
    from usagelens.operators import teams

    t = _t(spark, sf_dir)
    return teams.team_rosters(t.teams, t.team_members, nested=False)


@register("team_rosters_masked")
def q_team_rosters_m(spark, sf_dir):
    from usagelens.operators import teams

    t = _t(spark, sf_dir)
    return teams.team_rosters(t.teams, t.team_members, t.user_aliases, masked=True, nested=False)


@register("all_identities")
def q_identities(spark, sf_dir):
    from usagelens.operators import aliases

    return aliases.all_identities(_t(spark, sf_dir))


@register("assign_aliases")
def q_assign_aliases(spark, sf_dir):
    from usagelens.operators import aliases

    t = _t(spark, sf_dir)
    return stable(aliases.assign_aliases(aliases.all_identities(t), t.user_aliases, fixtures.AS_OF))


@register("mask_strict")
def q_mask_strict(spark, sf_dir):
    from usagelens.operators import aliases

    t = _t(spark, sf_dir)
    return aliases.mask(t.api_errors.select("id", "user_email", "error_message"), t.user_aliases, strict=True)


# ── usage report ────────────────────────────────────────────────────────────
REPORT_FROM, REPORT_TO = dt.date(2024, 1, 5), dt.date(2024, 1, 25)


@register("reported_cost_by_user")
def q_reported(spark, sf_dir):
    from usagelens.operators import report
    from usagelens.plans import derived
    from usagelens.sources import usage_report

    from usagelens.plans import landed

    recs = usage_report.read_usage_report(spark, landed.usage_report_dir(spark, sf_dir), REPORT_FROM, REPORT_TO,
                                          one_page_per_file=False)
    return stable(report.reported_cost_by_user(recs))


# ── model-invocation logs ───────────────────────────────────────────────────
def _inv(spark, sf_dir):
    from usagelens.plans import derived
    from usagelens.sources import invocations

    from usagelens.plans import landed

    t = _t(spark, sf_dir)
    ev = invocations.read_invocation_logs(spark, landed.invocation_log_dir(spark, sf_dir))
    return t, ev, derived.stored_request_ids(t)


@register("invocation_sync")
def q_inv_sync(spark, sf_dir):
    from usagelens.plans import derived
    from usagelens.sources import invocations

    t, ev, stored = _inv(spark, sf_dir)
    out = invocations.sync_invocations(ev, stored, dt.datetime.fromisoformat(derived.SYNC_FROM), fixtures.AS_OF)
    return stable(out.drop("id"), digits=8)


@register("invocation_sync_stats")
def q_inv_stats(spark, sf_dir):
    from usagelens.plans import derived
    from usagelens.sources import invocations

    t, ev, stored = _inv(spark, sf_dir)
    return invocations.sync_stats(ev, stored, dt.datetime.fromisoformat(derived.SYNC_FROM), fixtures.AS_OF)


@register("backfill_model_ids")
def q_backfill(spark, sf_dir):
    from usagelens.plans import derived
    from usagelens.sources import invocations

    return invocations.backfill_model_ids(derived.raw_model_rows(_t(spark, sf_dir)))


# ── streaming (availableNow runs over landed files) ─────────────────────────
@register("stream_usage_windows")
def q_stream_windows(spark, sf_dir):
    from usagelens.plans import streams

    return stable(streams.stream_usage_windows(spark, sf_dir))


@register("stream_daily_cost")
def q_stream_daily(spark, sf_dir):
    from usagelens.plans import streams

    return stable(streams.stream_daily_cost(spark, sf_dir))


@register("stream_usage_windows_hot_user")
def q_stream_windows_hot(spark, sf_dir):
    """A third of the stream's rows belong to one user."""
    from usagelens.plans import streams

    return stable(streams.stream_usage_windows(spark, sf_dir, hot=True))


def _stream_otlp_table(name):
    def q(spark, sf_dir):
        from usagelens.plans import streams

        return stable(streams.stream_otlp_table(spark, sf_dir, name), keep=RAW)
    return q


for _name in ("api_requests", "tool_uses", "user_prompts", "api_errors", "tool_decisions"):
    register(f"stream_otlp_{_name}")(_stream_otlp_table(_name))


@register("stream_otlp_quarantine")
def q_stream_quarantine(spark, sf_dir):
    from usagelens.plans import streams

    q = streams.stream_otlp_quarantine(spark, sf_dir)
    text = F.when(F.col("reason") == "invalid JSON", F.col("payload"))
    return q.groupBy("reason", text.alias("payload")).agg(F.count(F.lit(1)).alias("records"))


@register("sample_rows_ingested")
def q_stream_sample(spark, sf_dir):
    """H7 over ingested data: the latest rows by arrival of one batch read."""
    t = usage_tables(api_requests=_otlp_routed(spark, sf_dir)["api_requests"])
    return stable(usage.sample_rows(spark, t).drop("id"), keep=RAW)


@register("stream_synced_by_model")
def q_synced_by_model(spark, sf_dir):
    """Requests synced from the invocation log are found by every analytic."""
    from usagelens.plans import streams

    return stable(usage.by_model(spark, streams.synced_tables(spark, sf_dir), Filters(source="bedrock")))


@register("stream_ingested_summary")
def q_ingested_summary(spark, sf_dir):
    """KPIs over the tables a stream has written."""
    from usagelens.plans import streams

    return stable(usage.summary(spark, streams.ingested_tables(spark, sf_dir), ALL))


@register("stream_alias_coverage")
def q_stream_alias(spark, sf_dir):
    from usagelens.plans import streams

    return streams.stream_alias_coverage(spark, sf_dir)


@register("stream_invocations")
def q_stream_inv(spark, sf_dir):
    from usagelens.plans import streams

    return stable(streams.stream_invocations(spark, sf_dir), digits=8)


# ── filtered / masked variants of the main analytics ────────────────────────
MASKED = Filters(masked=True)


@register("cost_over_time_filtered")
def q_cot_f(spark, sf_dir):
    return stable(usage.cost_over_time(spark, _t(spark, sf_dir), MIXED))


@register("hourly_activity_filtered")
def q_hourly_f(spark, sf_dir):
    return stable(usage.hourly_activity(spark, _t(spark, sf_dir), MIXED))


@register("by_user_filtered")
def q_by_user_f(spark, sf_dir):
    return stable(usage.by_user(spark, _t(spark, sf_dir), MIXED, nested=False))


@register("user_model_breakdown_filtered")
def q_umb_f(spark, sf_dir):
    return stable(usage.user_model_breakdown(spark, _t(spark, sf_dir), MIXED))


@register("sessions_masked")
def q_sessions_m(spark, sf_dir):
    return stable(sessions.sessions(spark, _t(spark, sf_dir), MASKED))


@register("recent_events_masked")
def q_recent_m(spark, sf_dir):
    return stable(feed.recent_events(spark, _t(spark, sf_dir), MASKED, limit="120"), keep=RAW)


@register("weekly_windows_masked")
def q_weekly_m(spark, sf_dir):
    return stable(windows.weekly_windows(spark, _t(spark, sf_dir), MASKED))


@register("session_timeline_one_session")
def q_timeline_one(spark, sf_dir):
    t = _t(spark, sf_dir)
    return stable(sessions.session_timeline(t, A_SESSION, nested=False))


@register("session_conversation")
def q_conversation(spark, sf_dir):
    """J1 as the reference serves it: one session's ordered conversation
    (nested), flattened to one row per entry with its position; the tool
    list becomes an ordered name list."""
    t = _t(spark, sf_dir)
    c = sessions.session_conversation(t, A_SESSION)
    e = c.select("session_id", F.posexplode("conversation").alias("pos", "e"))
    return stable(e.select(
        "session_id", "pos", F.col("e.prompt_id").alias("prompt_id"), F.col("e.timestamp").alias("timestamp"),
        F.col("e.prompt").alias("prompt"), F.col("e.response").alias("response"), F.col("e.model").alias("model"),
        F.col("e.cost_usd").alias("cost_usd"), F.size("e.tools").alias("tool_count"),
        F.concat_ws(",", F.col("e.tools.tool_name")).alias("tool_names")))


# ── skew: one user holds a third of all requests ────────────────────────────
HOT_USER = "hot@example.com"


@register("session_windows_hot_user")
def q_windows_hot(spark, sf_dir):
    """Every third request is re-attributed to one user; the bucketed plan
    pre-aggregates that user's rows before the shuffle and windows over at
    most (time span / 5 h) bucket rows for it."""
    t = _t(spark, sf_dir)
    r = t.api_requests.withColumn(
        "user_email", F.when(F.col("id") % 3 == 0, F.lit(HOT_USER)).otherwise(F.col("user_email")))
    return stable(windows.session_windows(spark, t, ALL, requests=r))


# ── stored facts: newest days first, hourly rollups ─────────────────────────
def _stored_tables(spark, sf_dir):
    from usagelens.plans import landed
    from usagelens.sources import facts

    t = _t(spark, sf_dir)
    return facts.load_stored_tables(spark, landed.facts_root(spark, sf_dir), dims={
        n: getattr(t, n) for n in ("org_members", "user_aliases", "teams", "team_members")})


@register("recent_events_stored")
def q_recent_stored(spark, sf_dir):
    return stable(feed.recent_events(spark, _stored_tables(spark, sf_dir), ALL), keep=RAW)


@register("recent_events_stored_audience")
def q_recent_stored_aud(spark, sf_dir):
    return stable(feed.recent_events(spark, _stored_tables(spark, sf_dir), AUDIENCE_CLEAR, limit=200), keep=RAW)


def _register_rollups():
    from usagelens.operators import rollups

    for name in ("summary", "cost_over_time", "by_model", "tool_stats", "hourly_activity"):
        for suffix, f in (("", ALL), ("_filtered", MIXED)):
            def run(spark, sf_dir, name=name, f=f):
                return stable(getattr(rollups, name)(spark, _stored_tables(spark, sf_dir), f))
            run.__doc__ = f"{name} from hourly rollups of the stored facts."
            register(f"rollup_{name}{suffix}")(run)


_register_rollups()
