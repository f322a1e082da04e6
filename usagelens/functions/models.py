"""Model-id normalisation and list pricing for model-invocation logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelens.functions.jsvalues import js_round

# Fixed values (must equal the reference): list prices in USD per 1,000
# tokens, searched in this order; the first entry whose text occurs in the
# lower-cased model id wins.
PRICE_TABLE = [
    ("claude-3-5-sonnet-20241022", 0.003, 0.015),
    ("claude-3-5-sonnet-20240620", 0.003, 0.015),
    ("claude-3-5-haiku", 0.0008, 0.004),
    ("claude-3-opus", 0.015, 0.075),
    ("claude-3-sonnet", 0.003, 0.015),
    ("claude-3-haiku", 0.00025, 0.00125),
    ("claude-v2", 0.008, 0.024),
    ("claude-2", 0.008, 0.024),
    ("claude-instant", 0.0008, 0.0024),
]

# Cross-region inference-profile prefixes, then the vendor prefix.
REGION_PREFIXES = ["us", "eu", "apac", "ap", "ca", "sa", "af"]
VENDOR_PREFIX = "anthropic"


def normalize_model(raw: Column) -> Column:
    """Strip one leading region prefix, then one vendor prefix (case
    sensitive); '' or NULL -> NULL."""
    region = "^(" + "|".join(REGION_PREFIXES) + r")\."
    stripped = F.regexp_replace(F.regexp_replace(raw, region, ""), rf"^{VENDOR_PREFIX}\.", "")
    return F.when(F.nullif(raw, F.lit("")).isNotNull(), stripped)


def backfill_model_id(model: Column) -> Column:
    """One-time rewrite of stored ids: each prefix is stripped at most once,
    case-insensitively, in the fixed order (so 'US.anthropic.x' loses both
    prefixes, 'eu.us.x' keeps 'us.'). A single anchored pattern with the
    prefixes as ordered optional groups does exactly that in one pass."""
    groups = "".join(f"({p}\\.)?" for p in REGION_PREFIXES + [VENDOR_PREFIX])
    return F.regexp_replace(model, "^(?i)" + groups, "")


def list_price(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """(in * price_in + out * price_out) / 1000 rounded to 8 dp with JS
    rounding; unknown or missing model -> NULL. A CASE chain keeps the
    lookup inside the projection (no join, no shuffle)."""
    lm = F.lower(model)
    tin = F.coalesce(tokens_in, F.lit(0)).cast("double")
    tout = F.coalesce(tokens_out, F.lit(0)).cast("double")
    expr = None
    for match, pin, pout in PRICE_TABLE:
        cost = js_round(tin * F.lit(pin) / F.lit(1000.0) + tout * F.lit(pout) / F.lit(1000.0), 8)
        cond = lm.contains(match)
        expr = F.when(cond, cost) if expr is None else expr.when(cond, cost)
    return F.when(F.nullif(model, F.lit("")).isNotNull(), expr)


def arn_user(arn: Column) -> Column:
    """Text after the last '/' of an IAM ARN; empty -> NULL."""
    return F.nullif(F.substring_index(arn, "/", -1), F.lit(""))
