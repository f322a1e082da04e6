"""Hourly rollups of the stored facts, and the dashboard's questions over them.

A rollup row holds the sums of one hour for a user, session, model and source
(requests), a user (prompts, errors) or a user and tool. Rollups are stored
like facts, under the name of the write whose rows they sum up: a late row adds
to its hour, a replayed write replaces its own sums, and nothing is ever
recomputed. A time range takes its whole hours from the rollups and only the
two cut hours from the facts, so an answer reads a row per hour and session
instead of a row per event. Sessions are part of the key, so the distinct
counts are exact.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.operators.filters import apply_filters, in_period, resolve_audience, time_range
from usagelens.params import Filters, Tables

REQUEST_SUMS = ("cost_usd", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")


def _by_hour(rows: DataFrame, keys: tuple[str, ...], sums: list, also: tuple[str, ...]) -> DataFrame:
    hour = F.date_trunc("hour", "timestamp").alias("timestamp")
    return rows.groupBy(hour, *keys, *also).agg(*sums)


def _requests(rows: DataFrame, *also: str) -> DataFrame:
    return _by_hour(rows, ("user_email", "session_id", "model", "source"),
                    [F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(c) for c in REQUEST_SUMS]], also)


def _events(rows: DataFrame, *also: str) -> DataFrame:
    return _by_hour(rows, ("user_email",), [F.count(F.lit(1)).alias("events")], also)


def _tools(rows: DataFrame, *also: str) -> DataFrame:
    return _by_hour(rows, ("user_email", "tool_name"), [
        F.count(F.lit(1)).alias("uses"), F.count_if(F.col("success") == 1).alias("successes"), F.count_if(F.col("success") == 0).alias("failures"),
        F.sum("duration_ms").alias("duration_ms"), F.count("duration_ms").alias("timed")], also)


# rollup -> (fact table, its hourly sums; further columns become keys)
HOURLY = {"hourly_prompts": ("user_prompts", _events), "hourly_errors": ("api_errors", _events),
          "hourly_tools": ("tool_uses", _tools), "hourly_requests": ("api_requests", _requests)}


def _time(v) -> dt.datetime | None:
    if v is None:
        return None
    v = dt.datetime.fromisoformat(v.replace("Z", "")) if isinstance(v, str) else v
    if not isinstance(v, dt.datetime):
        return dt.datetime(v.year, v.month, v.day)
    return v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v


def whole_hours(f: Filters) -> tuple[dt.datetime | None, dt.datetime | None]:
    """[lo, hi) of the hours that lie within the filter's range as a whole."""
    lo, hi = _time(f.from_), _time(f.to)
    if lo is not None:
        start = lo.replace(minute=0, second=0, microsecond=0)
        lo = start if start == lo else start + dt.timedelta(hours=1)
    return lo, hi.replace(minute=0, second=0, microsecond=0) if hi is not None else None


def hourly(spark: SparkSession, t: Tables, name: str, f: Filters, aud=True, with_source: bool = False) -> DataFrame:
    """Rows of a rollup for exactly the events the filter keeps. ``t`` comes from
    ``load_stored_tables`` of a root with rollups."""
    stored, (fact, sums) = t.extra["rollups"][name], HOURLY[name]
    raw, (lo, hi) = getattr(t, fact), whole_hours(f)
    from_, to = _time(f.from_), _time(f.to)
    if lo is not None and hi is not None and lo >= hi:
        parts = [sums(time_range(raw, f.from_, f.to))]
    else:
        inside = stored
        if lo is not None:
            inside = time_range(inside, from_=lo)
        if hi is not None:
            inside = in_period(inside, dt.datetime(1, 1, 1), hi)
        parts = [inside]
        if lo is not None and from_ < lo:
            parts.append(sums(in_period(raw, from_, lo)))
        if hi is not None:
            parts.append(sums(time_range(raw, hi, to)))
    columns = [c for c in stored.columns if c != "event_date"]
    rows = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
    return apply_filters(spark, rows, t, f, with_source=with_source, with_time=False, aud=aud)


def _long(c: str):
    return F.sum(c).cast("bigint")


def summary(spark: SparkSession, t: Tables, f: Filters) -> DataFrame:
    """E1 from rollups."""
    aud = resolve_audience(spark, t, f)
    parts = []
    for kind, name in enumerate(("hourly_requests", "hourly_prompts", "hourly_errors")):
        rows, n = hourly(spark, t, name, f, aud, with_source=kind == 0), "requests" if kind == 0 else "events"
        none = {"cost_usd": "double", "input_tokens": "bigint", "output_tokens": "bigint", "user_email": "string", "session_id": "string"}
        parts.append(rows.select(F.lit(kind).alias("_kind"), F.col(n).alias("_n"),
                                 *[F.col(c) if kind == 0 else F.lit(None).cast(tp).alias(c) for c, tp in none.items()]))
    u = reduce(DataFrame.unionByName, parts)

    def number(kind):
        return F.coalesce(F.sum(F.when(F.col("_kind") == kind, F.col("_n"))), F.lit(0)).cast("bigint")

    return u.agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"), number(0).alias("total_requests"),
        F.coalesce(_long("input_tokens"), F.lit(0).cast("bigint")).alias("total_tokens_in"),
        F.coalesce(_long("output_tokens"), F.lit(0).cast("bigint")).alias("total_tokens_out"),
        number(1).alias("total_prompts"), number(2).alias("total_errors"),
        F.countDistinct("user_email").alias("unique_users"), F.countDistinct("session_id").alias("unique_sessions"))


def cost_over_time(spark: SparkSession, t: Tables, f: Filters) -> DataFrame:
    """E2 from rollups."""
    r = hourly(spark, t, "hourly_requests", f, with_source=True)
    return r.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.sum("cost_usd").alias("cost"), _long("input_tokens").alias("input_tokens"), _long("output_tokens").alias("output_tokens"),
        _long("requests").alias("requests")).orderBy("day")


def by_model(spark: SparkSession, t: Tables, f: Filters) -> DataFrame:
    """E3 from rollups."""
    r = hourly(spark, t, "hourly_requests", f, with_source=True)
    return r.groupBy("model").agg(_long("requests").alias("requests"), F.sum("cost_usd").alias("cost"),
                                  *[_long(c).alias(c) for c in REQUEST_SUMS[1:]]).orderBy(F.desc("cost"))


def tool_stats(spark: SparkSession, t: Tables, f: Filters) -> DataFrame:
    """E8 from rollups."""
    r = hourly(spark, t, "hourly_tools", f)
    return r.groupBy("tool_name").agg(
        *[_long(c).alias(c) for c in ("uses", "successes", "failures")],
        (F.sum("duration_ms").cast("double") / F.nullif(F.sum("timed"), F.lit(0))).alias("avg_duration_ms")).orderBy(F.desc("uses"))


def hourly_activity(spark: SparkSession, t: Tables, f: Filters) -> DataFrame:
    """E9 from rollups."""
    r = hourly(spark, t, "hourly_requests", f, with_source=True)
    return r.groupBy((F.dayofweek("timestamp") - 1).alias("dow"), F.hour("timestamp").alias("hour")).agg(
        _long("requests").alias("requests"), F.sum("cost_usd").alias("cost")).orderBy("dow", "hour")
