"""Recent-events feed: the four event tables as one newest-first list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.operators.aliases import mask
from usagelens.operators.filters import apply_filters, resolve_audience
from usagelens.params import Filters, Tables

DEFAULT_LIMIT = 50


def feed_limit(limit) -> int:
    """parseInt(limit) or 50: the leading integer ('12.7' -> 12); 0, junk and
    negatives -> 50."""
    import re

    m = re.match(r"\s*([+-]?\d+)", "" if limit is None else str(limit))
    n = int(m.group(1)) if m else 0
    return n if n > 0 else DEFAULT_LIMIT


def events_union(spark: SparkSession, t: Tables, f: Filters) -> DataFrame:
    """UNION ALL of requests, tool uses, prompts and errors. Slot
    ``model`` carries model / tool name / NULL / error message, slot
    ``cost_usd`` carries cost / duration / prompt length / status code."""
    aud = resolve_audience(spark, t, f)

    def a(df):
        # Audience only: no time or source filter on the feed.
        return apply_filters(spark, df, t, f, with_source=False, with_time=False, aud=aud)

    d, s, lg, n = "double", "string", "bigint", lambda tp: F.lit(None).cast(tp)
    req = a(t.api_requests).select(
        F.lit("api_request").alias("type"), "id", "timestamp", "user_email", "model",
        F.col("cost_usd").cast(d).alias("cost_usd"), "session_id",
        F.col("input_tokens").cast(lg).alias("input_tokens"), F.col("output_tokens").cast(lg).alias("output_tokens"),
        "source")
    tool = a(t.tool_uses).select(
        F.lit("tool_use").alias("type"), "id", "timestamp", "user_email", F.col("tool_name").alias("model"),
        F.col("duration_ms").cast(d).alias("cost_usd"), "session_id", n(lg).alias("input_tokens"),
        n(lg).alias("output_tokens"), n(s).alias("source"))
    prompt = a(t.user_prompts).select(
        F.lit("prompt").alias("type"), "id", "timestamp", "user_email", n(s).alias("model"),
        F.col("prompt_length").cast(d).alias("cost_usd"), "session_id", n(lg).alias("input_tokens"),
        n(lg).alias("output_tokens"), n(s).alias("source"))
    err = a(t.api_errors).select(
        F.lit("error").alias("type"), "id", "timestamp", "user_email", F.col("error_message").alias("model"),
        F.col("status_code").cast(d).alias("cost_usd"), "session_id", n(lg).alias("input_tokens"),
        n(lg).alias("output_tokens"), n(s).alias("source"))
    return req.unionByName(tool).unionByName(prompt).unionByName(err)


def newest_first() -> list:
    """Newest first; rows of one instant in a fixed order, so that a cut among
    them is repeatable."""
    return [F.desc("timestamp"), F.asc("type"), F.desc("id")]


def _since(t: Tables, day: str) -> Tables:
    facts = ("api_requests", "tool_uses", "user_prompts", "api_errors")
    return t.with_(**{n: getattr(t, n).where(F.col("event_date") >= F.lit(day).cast("date")) for n in facts})


def _last_days(spark: SparkSession, t: Tables, f: Filters, k: int) -> Tables:
    """``t`` cut to the newest days that hold ``k`` events (days double until
    they do). Every event outside lies before these days, so the newest k are
    all within; with fewer than k events in all days nothing is cut."""
    days, n = t.extra["days"], 1
    while n < len(days):
        cut = _since(t, days[n - 1])
        if events_union(spark, cut, f).limit(k).count() >= k:
            return cut
        n *= 2
    return t


def recent_events(spark: SparkSession, t: Tables, f: Filters, limit=DEFAULT_LIMIT) -> DataFrame:
    """H3: newest ``limit`` events (a top-k: each task keeps its own k). Stored
    tables (``load_stored_tables``) are read from the newest day on, and only as
    far back as the answer reaches."""
    k = feed_limit(limit)
    if t.extra.get("days"):
        t = _last_days(spark, t, f, k)
    out = events_union(spark, t, f).orderBy(*newest_first()).limit(k)
    if f.masked:
        out = mask(out, t.user_aliases).orderBy(*newest_first())
    return out
