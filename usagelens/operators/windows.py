"""Gap-based activity windows (5-hour sessions, 7-day windows).

Semantics: per user (NULL user is one group), requests ordered by time; a
request opens a new window when it is the user's first or when the gap to
the previous request, rounded to whole seconds (half up), exceeds the
threshold. Equal timestamps always share a window.

Plan: no window function over raw rows. Two requests closer than the
threshold can never be split, so each user's requests are first
pre-aggregated into fixed time buckets one threshold wide (a hash
aggregate with map-side combine, so a user holding a third of all rows is
reduced before the shuffle). The gap test then runs on bucket summaries:
LAG(max ts) over the user's buckets, a running sum of "new window" flags,
and a regroup per window, all on one hash partitioning of user_email. Two
exchanges: partial bucket sums by (user, bucket), then bucket rows by user.
A user has at most (time span / threshold) buckets, whatever their row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.functions.jsvalues import js_round
from usagelens.operators.aliases import mask
from usagelens.operators.filters import apply_filters
from usagelens.params import Filters, Tables

SESSION_GAP_SECONDS = 18000     # 5 hours
WEEKLY_GAP_SECONDS = 604800     # 7 days (a gap, not calendar weeks)
_US_PER_S = 1_000_000
_US_PER_H = 3_600_000_000


def buckets(requests: DataFrame, gap_seconds: int) -> DataFrame:
    """One row per (user, time bucket one threshold wide): first and last
    instant, cost, tokens, requests. Works on a stream as it is."""
    us = F.unix_micros(F.col("timestamp"))
    width = gap_seconds * _US_PER_S
    return (
        requests.select(
            "user_email", us.alias("_us"), "cost_usd",
            (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("_tok"))
        .groupBy("user_email", F.floor(F.col("_us") / F.lit(width)).alias("bucket"))
        .agg(F.min("_us").alias("t0"), F.max("_us").alias("t1"),
             F.sum("cost_usd").alias("cost"), F.sum("_tok").alias("tokens"),
             F.count(F.lit(1)).alias("requests"))
    )


def window_flags(requests: DataFrame, gap_seconds: int) -> DataFrame:
    """F1 + F2 on bucket summaries: gap_seconds to the user's previous
    request (whole seconds, rounded) and the running window_id."""
    return bucket_flags(buckets(requests, gap_seconds), gap_seconds)


def bucket_flags(rows: DataFrame, gap_seconds: int) -> DataFrame:
    """``window_flags`` of ready buckets."""
    w = Window.partitionBy("user_email").orderBy("bucket")
    prev = F.lag("t1").over(w)
    b = rows.withColumn(
        "gap_seconds", F.round((F.col("t0") - prev) / F.lit(float(_US_PER_S))))
    flag = F.when(F.col("gap_seconds").isNull() | (F.col("gap_seconds") > gap_seconds), 1).otherwise(0)
    return b.withColumn("window_id", F.sum(flag).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def usage_windows(requests: DataFrame, gap_seconds: int) -> DataFrame:
    """one row per (user, window)."""
    return bucket_windows(buckets(requests, gap_seconds), gap_seconds)


def bucket_windows(rows: DataFrame, gap_seconds: int) -> DataFrame:
    """``usage_windows`` of ready buckets."""
    return (
        bucket_flags(rows, gap_seconds)
        .groupBy("user_email", "window_id")
        .agg(F.sum("cost").alias("total_cost"),
             F.sum("tokens").cast("bigint").alias("total_tokens"),
             F.sum("requests").cast("bigint").alias("request_count"),
             F.timestamp_micros(F.min("t0")).alias("window_start"),
             F.timestamp_micros(F.max("t1")).alias("window_end"),
             ((F.max("t1") - F.min("t0")) / F.lit(float(_US_PER_H))).alias("duration_hours"))
    )


def per_user_windows(windows: DataFrame) -> DataFrame:
    """per-user rollup of the windows (unordered)."""
    return (
        windows.groupBy("user_email")
        .agg(F.count(F.lit(1)).alias("window_count"),
             F.round(F.sum("total_cost"), 6).alias("total_cost"),
             F.sum("total_tokens").cast("bigint").alias("total_tokens"),
             F.sum("request_count").cast("bigint").alias("total_requests"),
             F.round(F.sum("duration_hours"), 4).alias("total_hours"))
    )


def label_requests(requests: DataFrame, gap_seconds: int) -> DataFrame:
    """Each request with its window_id (a join of the rows with their
    bucket's window, co-partitioned on (user_email, bucket))."""
    us = F.unix_micros(F.col("timestamp"))
    rows = requests.withColumn("bucket", F.floor(us / F.lit(gap_seconds * _US_PER_S)))
    ids = window_flags(requests, gap_seconds).select("user_email", "bucket", "window_id")
    return rows.join(ids, (rows["user_email"].eqNullSafe(ids["user_email"])) & (rows["bucket"] == ids["bucket"]),
                     "left").drop(ids["user_email"]).drop(ids["bucket"]).drop(rows["bucket"])


def gap_windows(spark: SparkSession, t: Tables, f: Filters, gap_seconds: int,
                requests: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """F5/F6 body, most expensive first (``ordered=False`` leaves out the sort,
    for what only sums the rows up). The filter is applied before the gap test
    (it changes the windows), so it is written first; Catalyst keeps it below
    the window."""
    r = apply_filters(spark, requests if requests is not None else t.api_requests, t, f)
    out = per_user_windows(usage_windows(r, gap_seconds))
    if f.masked:
        out = mask(out, t.user_aliases)
    return out.orderBy(F.desc("total_cost")) if ordered else out


def session_windows(spark: SparkSession, t: Tables, f: Filters, requests: DataFrame | None = None,
                    ordered: bool = True) -> DataFrame:
    """5-hour windows, per-user rollup."""
    return gap_windows(spark, t, f, SESSION_GAP_SECONDS, requests, ordered)


def weekly_windows(spark: SparkSession, t: Tables, f: Filters, requests: DataFrame | None = None,
                   ordered: bool = True) -> DataFrame:
    """7-day-gap windows, per-user rollup."""
    return gap_windows(spark, t, f, WEEKLY_GAP_SECONDS, requests, ordered)


def window_summary(per_user: DataFrame) -> DataFrame:
    """global summary from the per-user rows (zero windows -> zeros)."""
    s = per_user.agg(
        F.coalesce(F.sum("window_count"), F.lit(0)).cast("bigint").alias("n"),
        F.coalesce(F.sum(F.coalesce("total_cost", F.lit(0.0))), F.lit(0.0)).alias("c"),
        F.coalesce(F.sum(F.coalesce("total_tokens", F.lit(0))), F.lit(0)).cast("double").alias("tok"),
        F.coalesce(F.sum(F.coalesce("total_requests", F.lit(0))), F.lit(0)).cast("double").alias("req"),
        F.coalesce(F.sum(F.coalesce("total_hours", F.lit(0.0))), F.lit(0.0)).alias("h"),
    )
    n, c, h = F.col("n"), F.col("c"), F.col("h")
    has = n > 0
    return s.select(
        n.alias("total_windows"),
        F.when(has, c / n).otherwise(0.0).alias("avg_cost_per_window"),
        F.when(has, js_round(F.col("tok") / n)).otherwise(0.0).cast("bigint").alias("avg_tokens_per_window"),
        F.when(has, js_round(F.col("req") / n)).otherwise(0.0).cast("bigint").alias("avg_requests_per_window"),
        F.when(has, js_round(h / n, 2)).otherwise(0.0).alias("avg_duration_hours"),
        F.when(h > 0, js_round(c / h, 2)).alias("avg_cost_per_active_hour"),
        js_round(c, 2).alias("total_cost"),
        js_round(h, 2).alias("total_active_hours"),
    )
