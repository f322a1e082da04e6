"""Fact and dimension tables derived from the driver's parquet tables.

The reference ships no data, so the test inputs are its five fact tables
filled deterministically from ``events`` (and ``orders`` for sparse
activity). Everything here is a projection/filter of one scan, so Catalyst
prunes columns and pushes the ``event_type`` predicate into the parquet
reader; nothing is materialised.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.params import PlanConfig, Tables
from usagelens.session import configure

# Fixed parameters of the registered queries.
AS_OF = dt.datetime(2024, 1, 20, 12, 0, 0)
PLAN = PlanConfig(
    billing_cycle_day=1, standard_seat_cost_usd=20, premium_seat_cost_usd=100,
    commitment_amount_usd=5000, commitment_start_date="2024-01-01",
    commitment_end_date="2024-12-31", commitment_discount_pct=10,
)
TEAM_NAMES = [(1, "alpha"), (2, "beta"), (3, "empty")]
IMPORTED_AT = dt.datetime(2024, 1, 1, 0, 0, 0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _email(user_id: Column) -> Column:
    return (
        F.when(user_id % 25 == 7, F.lit(None).cast("string"))
        .when(user_id % 25 == 3, F.concat(F.lit("User"), user_id.cast("string"), F.lit("@Example.com")))
        .otherwise(F.concat(F.lit("user"), user_id.cast("string"), F.lit("@example.com")))
    )


def base(events: DataFrame) -> DataFrame:
    day = F.to_date("ts").cast("string")
    uid = F.col("user_id").cast("string")
    return events.select(
        F.col("event_id").alias("id"),
        # NTZ wall clock read as UTC (session time zone is pinned to UTC).
        F.col("ts").cast("timestamp").alias("timestamp"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("s_"), uid, F.lit("_"), day).alias("session_id"),
        F.concat(F.lit("p_"), uid, F.lit("_"), day, F.lit("_"),
                 F.floor(F.hour("ts") / 12).cast("int").cast("string")).alias("prompt_id"),
        _email(F.col("user_id")).alias("user_email"),
    )


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


def _common(b: DataFrame) -> list[Column]:
    return [
        F.col("id"), F.col("timestamp"), F.col("session_id"), F.col("prompt_id"),
        F.col("user_email"), _null("string").alias("user_id"), _null("string").alias("org_id"),
    ]


def api_requests(b: DataFrame, extra: tuple = ()) -> DataFrame:
    k, i = F.col("k"), F.col("id")
    model = (F.when(k % 5 == 0, "model-a").when(k % 5 == 1, "model-b")
             .when(k % 5 == 2, "model-c").when(k % 5 == 3, "model-d"))
    source = (F.when(k % 4 == 1, "claude_code").when(k % 4 == 2, "opencode")
              .when(k % 4 == 3, "bedrock"))
    return b.filter(F.col("event_type").isin("view", "purchase")).select(
        *_common(b),
        model.alias("model"),
        F.when(k % 17 != 0, F.col("value") / 100).alias("cost_usd"),
        F.when(k % 11 != 0, 500 + (i * 37) % 8000).alias("input_tokens"),
        (200 + (i * 53) % 4000).alias("output_tokens"),
        F.when(k % 3 != 0, (i * 29) % 3000).alias("cache_read_tokens"),
        ((i * 13) % 500).alias("cache_creation_tokens"),
        (300 + (i * 7) % 5000).alias("duration_ms"),
        _null("string").alias("app_version"),
        _null("string").alias("terminal_type"),
        F.concat(F.lit("response "), i.cast("string")).alias("response_content"),
        source.alias("source"),
        _null("string").alias("aws_request_id"),
        *extra,
    )


def tool_uses(b: DataFrame, extra: tuple = ()) -> DataFrame:
    k, i = F.col("k"), F.col("id")
    return b.filter((F.col("event_type") == "click") & (k < 80)).select(
        *_common(b),
        F.concat(F.lit("tool_"), (k % 10).cast("string")).alias("tool_name"),
        F.when(k % 20 == 0, 0).otherwise(1).alias("success"),
        F.when(k % 13 != 0, 10 + (i * 11) % 3000).alias("duration_ms"),
        F.when(k % 20 == 0, F.lit("Command failed")).alias("error"),
        *extra,
    )


def tool_decisions(b: DataFrame, extra: tuple = ()) -> DataFrame:
    k = F.col("k")
    return b.filter((F.col("event_type") == "click") & (k >= 80)).select(
        *_common(b),
        F.concat(F.lit("tool_"), (k % 10).cast("string")).alias("tool_name"),
        F.when(k % 4 == 0, "reject").otherwise("accept").alias("decision"),
        *extra,
    )


def user_prompts(b: DataFrame, extra: tuple = ()) -> DataFrame:
    return b.filter(F.col("event_type") == "signup").select(
        *_common(b),
        (20 + F.col("k")).cast("bigint").alias("prompt_length"),
        F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("prompt_content"),
        *extra,
    )


def api_errors(b: DataFrame, extra: tuple = ()) -> DataFrame:
    k = F.col("k")
    return b.filter(F.col("event_type") == "error").select(
        *_common(b),
        F.when(k % 2 == 0, "Rate limit exceeded").otherwise("Internal server error").alias("error_message"),
        F.when(k % 2 == 0, 429).otherwise(500).alias("status_code"),
        (k % 3).alias("retries"),
        *extra,
    )


def org_members(events: DataFrame) -> DataFrame:
    u = F.col("user_id")
    return (
        events.filter(u % 10 != 9).select(u).distinct().select(
            F.concat(F.lit("user"), u.cast("string"), F.lit("@example.com")).alias("email"),
            F.when(u % 5 != 0, F.concat(F.lit("Name "), u.cast("string"))).alias("name"),
            _null("string").alias("role"),
            _null("string").alias("status"),
            F.when(u % 4 == 0, "Premium").when(u % 4 == 1, F.lit(None)).otherwise("Standard").alias("seat_tier"),
            F.when(u % 3 == 0, "enterprise").otherwise("seat").alias("billing_model"),
            F.lit(IMPORTED_AT).cast("timestamp").alias("imported_at"),
        )
    )


def teams(spark: SparkSession) -> DataFrame:
    # A three-row dimension: the team catalogue itself, not telemetry.
    return spark.createDataFrame(TEAM_NAMES, "id bigint, name string").select(
        "id", "name", F.lit(IMPORTED_AT).cast("timestamp").alias("created_at"))


def team_members_from_events(events: DataFrame) -> DataFrame:
    """Users with user_id % 10 = 1 are in team 1, = 2 in team 2."""
    u = F.col("user_id")
    return (
        events.filter((u % 10).isin(1, 2)).select(u).distinct()
        .select((u % 10).cast("bigint").alias("team_id"), _email(u).alias("user_email"))
        .filter(F.col("user_email").isNotNull())
    )


def initial_aliases(t: Tables) -> DataFrame:
    """Aliases for the users with an even number, in the order of their emails."""
    from usagelens.operators.aliases import all_identities, assign_aliases

    number = F.regexp_extract("email", "[0-9]+", 0).cast("bigint")
    return assign_aliases(all_identities(t).filter(number % 2 == 0), None, IMPORTED_AT)


def sparse_requests(orders: DataFrame) -> DataFrame:
    """api_requests-shaped rows at day granularity (many equal timestamps)."""
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        _null("string").alias("session_id"),
        _null("string").alias("prompt_id"),
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("user_email"),
        _null("string").alias("model"),
        (F.col("o_totalprice") / 10000).alias("cost_usd"),
        (F.col("o_orderkey") % 900).alias("input_tokens"),
        (F.col("o_orderkey") % 700).alias("output_tokens"),
        _null("string").alias("source"),
    )


_TABLES: dict = {}


def session_key(spark: SparkSession) -> int:
    return spark._jsparkSession.hashCode()


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The fixture tables of ``sf_dir``, built once per session (DataFrames
    are immutable plans, so every query can share them)."""
    configure(spark)
    key = (session_key(spark), os.path.abspath(sf_dir))
    if key not in _TABLES:
        _TABLES[key] = _build_tables(spark, sf_dir)
    return _TABLES[key]


def _build_tables(spark: SparkSession, sf_dir: str) -> Tables:
    events = read_table(spark, sf_dir, "events")
    b = base(events)
    t = Tables(
        api_requests=api_requests(b),
        tool_uses=tool_uses(b),
        user_prompts=user_prompts(b),
        api_errors=api_errors(b),
        tool_decisions=tool_decisions(b),
        org_members=org_members(events),
        teams=teams(spark),
        team_members=team_members_from_events(events),
    )
    t.user_aliases = initial_aliases(t)
    _land_dimensions(spark, t)
    t.extra["sparse_requests"] = sparse_requests(read_table(spark, sf_dir, "orders"))
    t.extra["events"] = events
    t.extra["base"] = b
    return t


def _land_dimensions(spark: SparkSession, t: Tables) -> None:
    """Dimensions are small stored tables in production. Here they are
    derived from ``events``; write them once per session under the
    checkpoint folder and read them back, so queries do not re-derive them
    from full scans."""
    from usagelens.session import scratch_path

    root = scratch_path(spark, "dims")
    for name in ("org_members", "team_members", "user_aliases"):
        path = f"{root}/{name}"
        getattr(t, name).write.parquet(path)
        setattr(t, name, spark.read.parquet(path))
