"""Billing period, per-user billing, commitment pool and pacing."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.functions.jsvalues import js_round, money_sum
from usagelens.operators.aliases import mask
from usagelens.operators.filters import in_period
from usagelens.params import PlanConfig, Tables

_MS_PER_DAY = 86_400_000


def _js_round(x: float) -> int:
    import math

    return int(math.floor(x + 0.5))


@dataclass(frozen=True)
class BillingPeriod:
    start: dt.datetime   # UTC instants, half-open [start, end)
    end: dt.datetime
    days_elapsed: int
    days_remaining: int
    total_days: int


def billing_period(as_of: dt.datetime, cycle_day: int = 1, tz: str = "UTC") -> BillingPeriod:
    """The cycle containing ``as_of``: from this month's cycle day (if
    reached, else last month's) to one month later, at local midnight in
    ``tz``. Day counts round the millisecond difference like Math.round."""
    cycle_day = min(28, max(1, int(cycle_day)))
    zone = ZoneInfo(tz)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    local = as_of.astimezone(zone)
    y, m = local.year, local.month
    if local.day < cycle_day:
        y, m = (y - 1, 12) if m == 1 else (y, m - 1)
    ny, nm = (y + 1, 1) if m == 12 else (y, m + 1)
    start = dt.datetime(y, m, cycle_day, tzinfo=zone).astimezone(dt.timezone.utc)
    end = dt.datetime(ny, nm, cycle_day, tzinfo=zone).astimezone(dt.timezone.utc)
    ms = lambda d: (d - start) / dt.timedelta(milliseconds=1)
    total = _js_round(ms(end) / _MS_PER_DAY)
    elapsed = _js_round(ms(as_of) / _MS_PER_DAY)
    naive = lambda d: d.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return BillingPeriod(naive(start), naive(end), elapsed, total - elapsed, total)


def billing_period_df(spark: SparkSession, p: BillingPeriod) -> DataFrame:
    return spark.createDataFrame(
        [(p.start, p.end, p.days_elapsed, p.days_remaining, p.total_days)],
        "start timestamp, end timestamp, days_elapsed int, days_remaining int, total_days int")


def roster_by_lower_email(members: DataFrame) -> DataFrame:
    """The roster keyed by lower(email); rows differing only in case would
    fan a request out twice, so the latest import wins (then the email)."""
    w = Window.partitionBy("_lemail").orderBy(F.desc_nulls_last("imported_at"), F.desc("email"))
    return (
        members.withColumn("_lemail", F.lower("email"))
        .withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    )


def join_roster(requests: DataFrame, members: DataFrame | None) -> DataFrame:
    """G1: requests LEFT JOIN roster on lower(email), with the defaults
    name=email, seat_tier='Standard', billing_model='seat'."""
    if members is None:
        members = requests.sparkSession.createDataFrame(
            [], "email string, name string, seat_tier string, billing_model string, imported_at timestamp")
    m = (roster_by_lower_email(members).select(
        "_lemail", F.col("name").alias("_m_name"), F.col("seat_tier").alias("_m_tier"),
        F.col("billing_model").alias("_m_model")))
    j = requests.join(m, F.lower(requests["user_email"]) == m["_lemail"], "left")
    return j.select(
        *[requests[c] for c in requests.columns],
        F.coalesce("_m_name", requests["user_email"]).alias("name"),
        F.coalesce("_m_tier", F.lit("Standard")).alias("seat_tier"),
        F.coalesce("_m_model", F.lit("seat")).alias("billing_model"),
    )


def enterprise_spend(requests: DataFrame, members: DataFrame | None, start, end) -> DataFrame:
    """Requests of enterprise-billed users in [start, end). The
    billing_model predicate turns the left join into an inner one."""
    r = in_period(requests, start, end)
    return join_roster(r, members).filter(F.col("billing_model") == "enterprise")


def not_in_roster(requests: DataFrame, members: DataFrame | None) -> DataFrame:
    """Distinct telemetry users whose lower-cased email is not in the
    roster (each spelling kept apart)."""
    users = requests.select("user_email").filter(F.col("user_email").isNotNull()).distinct()
    if members is None:
        return users
    m = members.select(F.lower("email").alias("_lemail")).filter(F.col("_lemail").isNotNull())
    return users.join(m, F.lower(users["user_email"]) == m["_lemail"], "left_anti")


def billing_by_user(spark: SparkSession, t: Tables, plan: PlanConfig, as_of: dt.datetime,
                    masked: bool = False, tz: str = "UTC") -> DataFrame:
    """Per-user spend in the current billing period joined to the
    roster; effective_cost = round4(cost * (1 - discount))."""
    p = billing_period(as_of, plan.billing_cycle_day, tz)
    r = in_period(t.api_requests, p.start, p.end)
    j = join_roster(r, t.org_members)
    out = j.groupBy("user_email", "name", "seat_tier", "billing_model").agg(
        money_sum("cost_usd").alias("api_equivalent_cost"),
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).cast("bigint").alias("tokens"),
    ).withColumn(
        "effective_cost",
        js_round(F.coalesce("api_equivalent_cost", F.lit(0.0)) * F.lit(plan.discount_factor), 4),
    )
    if masked:
        out = mask(out, t.user_aliases, cols=("user_email", "name"))
    return out.orderBy(F.desc("api_equivalent_cost"))


def billing_totals(by_user: DataFrame) -> DataFrame:
    """Total list cost (2 dp) and total tokens over the per-user rows."""
    return by_user.agg(
        js_round(F.coalesce(money_sum(F.coalesce("api_equivalent_cost", F.lit(0.0))), F.lit(0.0)), 2)
        .alias("total_api_equivalent_cost"),
        F.coalesce(F.sum(F.coalesce("tokens", F.lit(0))), F.lit(0)).cast("bigint").alias("total_tokens"),
    )


def commitment_window(plan: PlanConfig, as_of: dt.datetime, tz: str = "UTC") -> tuple[dt.datetime, dt.datetime]:
    """Start/end instants of the commitment: configured dates (whole days,
    end at 23:59:59.999) or, when unset, the billing period's dates (so the
    end then runs one day past the period, as the reference does)."""
    p = billing_period(as_of, plan.billing_cycle_day, tz)
    s = plan.commitment_start_date or p.start.strftime("%Y-%m-%d")
    e = plan.commitment_end_date or p.end.strftime("%Y-%m-%d")
    parse = lambda v: dt.datetime.fromisoformat(v.replace("Z", "")).replace(tzinfo=None)
    start = parse(s + "T00:00:00.000") if len(s) == 10 else parse(s)
    end = parse(e + "T23:59:59.999") if len(e) == 10 else parse(e)
    return start, end


def commitment_pool(t: Tables, plan: PlanConfig, as_of: dt.datetime, tz: str = "UTC") -> DataFrame:
    """List cost of enterprise members inside the commitment window."""
    start, end = commitment_window(plan, as_of, tz)
    return enterprise_spend(t.api_requests, t.org_members, start, end).agg(
        F.coalesce(money_sum("cost_usd"), F.lit(0.0)).alias("list_cost"))


def commitment_status(t: Tables, plan: PlanConfig, as_of: dt.datetime, tz: str = "UTC") -> DataFrame | None:
    """Pacing of the commitment (None when no commitment is set)."""
    amount = plan.commitment_amount_usd
    if not amount or amount <= 0:
        return None
    start, end = commitment_window(plan, as_of, tz)
    total = max(1, _js_round(((end - start) / dt.timedelta(milliseconds=1)) / _MS_PER_DAY))
    now = as_of.astimezone(dt.timezone.utc).replace(tzinfo=None) if as_of.tzinfo else as_of
    elapsed = max(0, min(total, _js_round(((now - start) / dt.timedelta(milliseconds=1)) / _MS_PER_DAY)))
    remaining_days = max(0, total - elapsed)
    expected = amount * elapsed / total
    pool = commitment_pool(t, plan, as_of, tz)
    list_cost = F.col("list_cost")
    consumed = list_cost * F.lit(plan.discount_factor)
    return pool.select(
        F.lit(float(amount)).alias("amount_usd"),
        F.lit(float(plan.commitment_discount_pct)).alias("discount_pct"),
        F.lit(start).cast("timestamp").alias("start"),
        F.lit(end).cast("timestamp").alias("end"),
        js_round(list_cost, 2).alias("list_consumed"),
        js_round(consumed, 2).alias("consumed"),
        js_round(F.lit(float(amount)) - consumed, 2).alias("remaining"),
        (F.floor(consumed / F.lit(float(amount)) * 1000 + 0.5) / 10).alias("pct_consumed"),
        F.lit(total).alias("total_days"),
        F.lit(elapsed).alias("days_elapsed"),
        F.lit(remaining_days).alias("days_remaining"),
        js_round(F.lit(float(expected)), 2).alias("expected_so_far"),
        js_round(consumed - F.lit(float(expected)), 2).alias("pace_delta"),
    )


def seat_costs(plan: PlanConfig) -> dict:
    """Seat prices; included_usd defaults to the seat cost."""
    return {
        "standard": plan.standard_seat_cost_usd,
        "premium": plan.premium_seat_cost_usd,
        "standard_included": plan.standard_seat_included_usd
        if plan.standard_seat_included_usd is not None else plan.standard_seat_cost_usd,
        "premium_included": plan.premium_seat_included_usd
        if plan.premium_seat_included_usd is not None else plan.premium_seat_cost_usd,
        "standard_overage_pct": plan.standard_seat_overage_pct or 0,
        "premium_overage_pct": plan.premium_seat_overage_pct or 0,
    }


def billing_summary(spark: SparkSession, t: Tables, plan: PlanConfig, as_of: dt.datetime,
                    masked: bool = False, tz: str = "UTC") -> dict:
    """The billing view as one bundle: period (one-row DataFrame), seat
    costs, commitment pacing (or None), totals and per-user rows."""
    by_user = billing_by_user(spark, t, plan, as_of, masked=masked, tz=tz)
    return {
        "billing_period": billing_period_df(spark, billing_period(as_of, plan.billing_cycle_day, tz)),
        "seat_costs": seat_costs(plan),
        "commitment": commitment_status(t, plan, as_of, tz),
        "totals": billing_totals(by_user),
        "by_user": by_user,
    }
