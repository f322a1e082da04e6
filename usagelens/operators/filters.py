"""Request filters: time range, audience, source, unmasking, periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.params import Filters, Tables

ALIAS_PATTERN = r"^USER-\d+$"


def ts_lit(v: dt.datetime | dt.date | str) -> Column:
    """A timestamp literal; strings are parsed (ISO date or date-time)."""
    if isinstance(v, str):
        return F.to_timestamp(F.lit(v.replace("Z", "")))
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        v = dt.datetime(v.year, v.month, v.day)
    return F.lit(v).cast("timestamp")


PARTITION_DATE = "event_date"


def _prune(df: DataFrame, lo=None, hi=None) -> DataFrame:
    """Stored fact tables are partitioned by the UTC date of ``timestamp``;
    a time predicate alone does not prune those folders, so the implied
    date bounds are added whenever the column is present."""
    if PARTITION_DATE not in df.columns:
        return df
    if lo is not None:
        df = df.filter(F.col(PARTITION_DATE) >= F.to_date(ts_lit(lo)))
    if hi is not None:
        df = df.filter(F.col(PARTITION_DATE) <= F.to_date(ts_lit(hi)))
    return df


def time_range(df: DataFrame, from_=None, to=None, col: str = "timestamp") -> DataFrame:
    """Both ends inclusive, each optional. Timestamps are compared as
    instants, so to='2024-01-31' keeps the row at exactly midnight."""
    df = _prune(df, from_, to)
    if from_ is not None:
        df = df.filter(F.col(col) >= ts_lit(from_))
    if to is not None:
        df = df.filter(F.col(col) <= ts_lit(to))
    return df


def in_period(df: DataFrame, start, end, col: str = "timestamp") -> DataFrame:
    """Half-open period start <= ts < end."""
    df = _prune(df, start, end)
    return df.filter((F.col(col) >= ts_lit(start)) & (F.col(col) < ts_lit(end)))


def known_only(df: DataFrame, col: str = "user_email") -> DataFrame:
    """Rows whose user column is known."""
    return df.filter(F.col(col).isNotNull())


def source_filter(df: DataFrame, source: str | None) -> DataFrame:
    """api_requests only. 'all'/None = off; 'claude_code' also matches
    rows stored before the source column existed (NULL)."""
    if not source or source == "all":
        return df
    if source == "claude_code":
        return df.filter(F.coalesce(F.col("source"), F.lit("claude_code")) == "claude_code")
    return df.filter(F.col("source") == source)


def unmask(values: DataFrame, col: str, aliases: DataFrame | None) -> DataFrame:
    """Replace ``col`` values that look like an alias (USER-n) with the
    aliased email; anything else (or an unknown alias) passes through."""
    if aliases is None:
        return values
    a = aliases.select(F.col("alias").alias("_alias"), F.col("email").alias("_email"))
    looks = F.col(col).rlike(ALIAS_PATTERN)
    joined = values.join(a, looks & (F.col(col) == F.col("_alias")), "left")
    return joined.withColumn(col, F.coalesce(F.col("_email"), F.col(col))).drop("_alias", "_email")


def resolve_audience(spark: SparkSession, t: Tables, f: Filters) -> DataFrame | None:
    """D3: users list ∪ members of the listed teams, trimmed, blanks dropped,
    de-duplicated and (when masking) unmasked. None = no audience filter; an
    empty DataFrame = nobody."""
    if not f.users and not f.teams:
        return None
    parts = []
    users = [u.strip() for u in (f.users or ()) if u and u.strip()]
    if users:
        # A literal list as a plan (not a parallelized Python list), so equal
        # audiences are recognised and their broadcast is reused.
        parts.append(spark.range(1).select(F.explode(F.array(*[F.lit(u) for u in users])).alias("email")))
    team_ids = [int(x) for x in (f.teams or ())]
    if team_ids and t.team_members is not None:
        parts.append(
            t.team_members.filter(F.col("team_id").isin(team_ids) & F.col("user_email").isNotNull())
            .select(F.col("user_email").alias("email"))
        )
    if not parts:
        return spark.createDataFrame([], "email string")
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p)
    raw = raw.distinct()
    if f.masked:
        raw = unmask(raw, "email", t.user_aliases).distinct()
    return raw


def audience(df: DataFrame, emails: DataFrame | None, col: str = "user_email") -> DataFrame:
    """None = no filter, else keep rows whose user is in the audience
    (a semi join; an empty audience gives no rows)."""
    if emails is None:
        return df
    a = emails.select(F.col("email").alias("_aud"))
    return df.join(a, F.col(col) == F.col("_aud"), "left_semi")


def apply_filters(
    spark: SparkSession, df: DataFrame, t: Tables, f: Filters, *, with_source: bool = True,
    with_time: bool = True, aud: DataFrame | None | bool = True,
) -> DataFrame:
    """The reference's WHERE clause: time range + audience (+ source, which
    exists on api_requests only)."""
    if with_time:
        df = time_range(df, f.from_, f.to)
    if aud is True:
        aud = resolve_audience(spark, t, f)
    if aud is not None and aud is not False:
        df = audience(df, aud)
    if with_source:
        df = source_filter(df, f.source)
    return df
