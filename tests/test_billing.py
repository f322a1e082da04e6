"""Billing calendar, commitment window, roster join."""

import datetime as dt

from usagelens.operators import billing
from usagelens.params import PlanConfig


def test_billing_period_cycle():
    p = billing.billing_period(dt.datetime(2024, 1, 20, 12), 1)
    assert (p.start, p.end, p.total_days, p.days_elapsed, p.days_remaining) == (
        dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1), 31, 20, 11)
    p = billing.billing_period(dt.datetime(2024, 1, 10), 15)
    assert (p.start, p.end, p.total_days) == (dt.datetime(2023, 12, 15), dt.datetime(2024, 1, 15), 31)
    p = billing.billing_period(dt.datetime(2024, 12, 20), 15)
    assert (p.start, p.end) == (dt.datetime(2024, 12, 15), dt.datetime(2025, 1, 15))
    assert billing.billing_period(dt.datetime(2024, 3, 30), 31).start == dt.datetime(2024, 3, 28)  # clamp 28
    p = billing.billing_period(dt.datetime(2024, 3, 15), 1, tz="America/New_York")
    assert p.start == dt.datetime(2024, 3, 1, 5) and p.end == dt.datetime(2024, 4, 1, 4)  # DST change


def test_plan_clamps():
    p = PlanConfig(billing_cycle_day=0, commitment_discount_pct=150)
    assert p.billing_cycle_day == 1 and p.commitment_discount_pct == 100 and p.discount_factor == 0


def test_commitment_window_fallback():
    plan = PlanConfig(billing_cycle_day=15, commitment_amount_usd=100)
    s, e = billing.commitment_window(plan, dt.datetime(2024, 1, 20))
    assert s == dt.datetime(2024, 1, 15) and e == dt.datetime(2024, 2, 15, 23, 59, 59, 999000)


def test_roster_case_duplicates_do_not_fan_out(spark):
    req = spark.createDataFrame([(1, "A@x.com", 2.0)], "id int, user_email string, cost_usd double")
    members = spark.createDataFrame(
        [("a@x.com", "Old", "Standard", "seat", dt.datetime(2024, 1, 1)),
         ("A@X.com", "New", "Premium", "enterprise", dt.datetime(2024, 2, 1))],
        "email string, name string, seat_tier string, billing_model string, imported_at timestamp")
    rows = billing.join_roster(req, members).collect()
    assert len(rows) == 1 and rows[0]["name"] == "New" and rows[0]["billing_model"] == "enterprise"
    none = billing.join_roster(req, None).first()
    assert (none["name"], none["seat_tier"], none["billing_model"]) == ("A@x.com", "Standard", "seat")
