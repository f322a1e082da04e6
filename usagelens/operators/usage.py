"""Flat usage aggregates: summary, daily cost, by model/user/tool, heatmap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.operators.aliases import ALIAS_PREFIX, mask
from usagelens.operators.filters import apply_filters, resolve_audience
from usagelens.params import Filters, Tables


def _sum_long(c: str) -> F.Column:
    return F.sum(c).cast("bigint")


def _all_tokens() -> F.Column:
    return (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
            + F.coalesce("cache_read_tokens", F.lit(0)) + F.coalesce("cache_creation_tokens", F.lit(0)))


def filtered_requests(spark: SparkSession, t: Tables, f: Filters, aud=True) -> DataFrame:
    return apply_filters(spark, t.api_requests, t, f, aud=aud)


def summary(spark: SparkSession, t: Tables, f: Filters) -> DataFrame:
    """One row of KPIs. One scan per table: the three inputs are tagged
    and unioned, then a single aggregation computes every figure (distinct
    counts go through Catalyst's Expand rewrite)."""
    aud = resolve_audience(spark, t, f)
    req = apply_filters(spark, t.api_requests, t, f, aud=aud).select(
        F.lit(0).alias("_kind"), "cost_usd", "input_tokens", "output_tokens", "user_email", "session_id")
    rest = []
    for kind, df in ((1, t.user_prompts), (2, t.api_errors)):
        # No source column on these tables: time + audience only.
        d = apply_filters(spark, df, t, f, with_source=False, aud=aud)
        rest.append(d.select(
            F.lit(kind).alias("_kind"), F.lit(None).cast("double").alias("cost_usd"),
            F.lit(None).cast("bigint").alias("input_tokens"), F.lit(None).cast("bigint").alias("output_tokens"),
            F.lit(None).cast("string").alias("user_email"), F.lit(None).cast("string").alias("session_id")))
    u = req.unionByName(rest[0]).unionByName(rest[1])
    is_req = F.col("_kind") == 0
    return u.agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"),
        F.count_if(is_req).alias("total_requests"),
        F.coalesce(_sum_long("input_tokens"), F.lit(0).cast("bigint")).alias("total_tokens_in"),
        F.coalesce(_sum_long("output_tokens"), F.lit(0).cast("bigint")).alias("total_tokens_out"),
        F.count_if(F.col("_kind") == 1).alias("total_prompts"),
        F.count_if(F.col("_kind") == 2).alias("total_errors"),
        F.countDistinct("user_email").alias("unique_users"),
        F.countDistinct("session_id").alias("unique_sessions"),
    )


def cost_over_time(spark: SparkSession, t: Tables, f: Filters) -> DataFrame:
    """Per UTC day."""
    r = filtered_requests(spark, t, f)
    return (
        r.groupBy(F.to_date("timestamp").alias("day"))
        .agg(F.sum("cost_usd").alias("cost"), _sum_long("input_tokens").alias("input_tokens"),
             _sum_long("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("requests"))
        .orderBy("day")
    )


def _token_sums() -> list[F.Column]:
    return [
        F.count(F.lit(1)).alias("requests"),
        F.sum("cost_usd").alias("cost"),
        _sum_long("input_tokens").alias("input_tokens"),
        _sum_long("output_tokens").alias("output_tokens"),
        _sum_long("cache_read_tokens").alias("cache_read_tokens"),
        _sum_long("cache_creation_tokens").alias("cache_creation_tokens"),
    ]


def by_model(spark: SparkSession, t: Tables, f: Filters) -> DataFrame:
    """Per model (NULL model is its own group), most expensive first."""
    r = filtered_requests(spark, t, f)
    return r.groupBy("model").agg(*_token_sums()).orderBy(F.desc("cost"))


def user_model_breakdown(spark: SparkSession, t: Tables, f: Filters) -> DataFrame:
    """E5: per (user, model): requests, cost, all four token kinds summed."""
    r = filtered_requests(spark, t, f)
    return (
        r.groupBy("user_email", "model")
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("cost_usd").alias("cost"),
             F.sum(_all_tokens()).cast("bigint").alias("total_tokens"))
        .orderBy("user_email", F.desc("total_tokens"))
    )


def _models_per_user(um: DataFrame) -> DataFrame:
    """E6 + E7 from the (user, model) rows: the top model (most tokens; ties
    go to the smallest model name, NULL first) and the per-model list.
    Both are plain aggregates; a user's list is bounded by the model count."""
    entry = F.struct(
        F.negative("total_tokens").alias("neg_tokens"), F.col("model").alias("model"),
        F.col("requests").alias("requests"), F.col("cost").alias("cost"),
        F.col("total_tokens").alias("total_tokens"))
    return um.groupBy("user_email").agg(
        F.min(entry).alias("_top"),
        F.sort_array(F.collect_list(entry)).alias("_models"),
    ).select(
        "user_email",
        F.nullif(F.col("_top.model"), F.lit("")).alias("top_model"),
        F.coalesce(F.col("_top.total_tokens"), F.lit(0).cast("bigint")).alias("top_model_tokens"),
        _models_list(F.col("_models")).alias("models"),
    )


def _models_list(entries: F.Column) -> F.Column:
    return F.transform(entries, lambda e: F.struct(
        e["model"].alias("model"), e["requests"].alias("requests"),
        e["cost"].alias("cost"), e["total_tokens"].alias("total_tokens")))


def top_model(spark: SparkSession, t: Tables, f: Filters) -> DataFrame:
    """Per user, the model with the most tokens."""
    return _models_per_user(user_model_breakdown(spark, t, f)).drop("models")


def by_user(spark: SparkSession, t: Tables, f: Filters, nested: bool = True) -> DataFrame:
    """Per user totals + distinct sessions + top model (+ models list).

    One scan: grouping sets give the (user, model) sums and the distinct (user,
    session) pairs, pre-aggregated before their exchange; a second aggregation
    over these few rows makes the user's row."""
    r = filtered_requests(spark, t, f)
    fine = r.groupingSets([["user_email", "model"], ["user_email", "session_id"]], "user_email", "model", "session_id").agg(
        F.grouping("model").alias("_by_session"), *_token_sums(), F.sum(_all_tokens()).cast("bigint").alias("total_tokens"))
    by_model_row = F.col("_by_session") == 0
    entry = F.when(by_model_row, F.struct(
        F.negative("total_tokens").alias("neg_tokens"), F.col("model").alias("model"), F.col("requests").alias("requests"),
        F.col("cost").alias("cost"), F.col("total_tokens").alias("total_tokens")))
    sums = ("requests", "cost", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    out = fine.groupBy("user_email").agg(
        *[F.sum(F.when(by_model_row, F.col(c))).alias(c) for c in sums],
        F.count_if(~by_model_row & F.col("session_id").isNotNull()).alias("sessions"),
        F.min(entry).alias("_top"), *([F.sort_array(F.collect_list(entry)).alias("_models")] if nested else []))
    out = out.select(
        "user_email", *sums, "sessions", F.nullif(F.col("_top.model"), F.lit("")).alias("top_model"),
        F.coalesce(F.col("_top.total_tokens"), F.lit(0).cast("bigint")).alias("top_model_tokens"),
        *([_models_list(F.col("_models")).alias("models")] if nested else []))
    if f.masked:
        out = mask(out, t.user_aliases)
    return out.orderBy(F.desc("cost"))


def tool_stats(spark: SparkSession, t: Tables, f: Filters) -> DataFrame:
    """Per tool (time + audience filters only)."""
    d = apply_filters(spark, t.tool_uses, t, f, with_source=False)
    return (
        d.groupBy("tool_name")
        .agg(F.count(F.lit(1)).alias("uses"),
             F.count_if(F.col("success") == 1).alias("successes"),
             F.count_if(F.col("success") == 0).alias("failures"),
             F.avg("duration_ms").alias("avg_duration_ms"))
        .orderBy(F.desc("uses"))
    )


def hourly_activity(spark: SparkSession, t: Tables, f: Filters) -> DataFrame:
    """Per (day of week 0=Sunday, hour) in UTC."""
    r = filtered_requests(spark, t, f)
    return (
        r.groupBy((F.dayofweek("timestamp") - 1).alias("dow"), F.hour("timestamp").alias("hour"))
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("cost_usd").alias("cost"))
        .orderBy("dow", "hour")
    )


def known_users(spark: SparkSession, t: Tables, masked: bool = False) -> DataFrame:
    """Distinct known emails; masked -> aliases in natural order
    (USER-2 before USER-10), unknown emails after them."""
    d = t.api_requests.select("user_email").filter(F.col("user_email").isNotNull()).distinct()
    if not masked:
        return d.orderBy("user_email")
    m = mask(d, t.user_aliases)
    num = F.when(F.col("user_email").startswith(ALIAS_PREFIX),
                 F.substring("user_email", len(ALIAS_PREFIX) + 1, 1 << 30).try_cast("bigint"))
    return m.orderBy(num.isNull(), num, "user_email")


def sample_rows(spark: SparkSession, t: Tables, n: int = 10) -> DataFrame:
    """H7: the latest stored requests: by arrival where the rows carry it
    (ingested data), else by id. A top-k: each task keeps its own n rows."""
    r = t.api_requests
    order = [F.desc_nulls_last("ingest_seq")] if "ingest_seq" in r.columns else []
    cols = ["id", "timestamp", "model", "cost_usd", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"]
    return r.orderBy(*order, F.desc("id")).limit(n).select(*cols)
