"""Vendor-reported cost per user from usage-report records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.jsvalues import js_round, money_sum
from usagelens.operators.aliases import mask


def reported_cost_by_user(records: DataFrame, aliases: DataFrame | None = None, masked: bool = False) -> DataFrame:
    """Per email: days_active (= number of records, not distinct days),
    tokens (input + output + cache_read), cost = round(cents) / 100.
    Records without an email are skipped."""
    out = records.filter(F.col("email").isNotNull() & (F.col("email") != "")).groupBy("email").agg(
        F.count(F.lit(1)).alias("days_active"),
        F.sum("tokens").cast("bigint").alias("reported_tokens"),
        money_sum("cents").alias("_cents"),
    ).select("email", (js_round(F.col("_cents")) / 100).alias("reported_cost"), "reported_tokens", "days_active")
    if masked:
        out = mask(out, aliases, cols=("email",), key="email")
    return out
