"""Roster maintenance: CSV merge, per-member patches, roster listing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.operators.aliases import mask
from usagelens.operators.filters import unmask

ROSTER_COLS = ["email", "name", "role", "status", "seat_tier", "billing_model", "imported_at"]
VALID_BILLING_MODELS = ("seat", "enterprise")
VALID_SEAT_TIERS = ("Standard", "Premium")


def merge_roster(current: DataFrame | None, rows: DataFrame, as_of: dt.datetime) -> DataFrame:
    """K1: upsert CSV rows by exact email. Several files count as imported one
    after the other in the order of their names, ``line`` is the order inside
    a file.

    name/role/status/seat_tier/imported_at are overwritten (also by NULL) by
    the file's last row for the email; billing_model only by the last
    non-blank cell ('enterprise' or else 'seat'), otherwise kept; new
    members default to 'seat'. Returns the whole new roster.
    """
    spark = rows.sparkSession
    raw = F.lower(F.trim(F.coalesce("billing_model_raw", F.lit(""))))
    at = F.struct("file", "line") if "file" in rows.columns else F.col("line")
    mapped = F.when(raw == "enterprise", "enterprise").otherwise("seat")
    f = rows.filter(F.col("email").isNotNull() & (F.col("email") != "")).groupBy("email").agg(
        F.max_by(F.struct("name", "role", "status", "seat_tier"), at).alias("_last"),
        F.max_by(mapped, F.when(raw != "", at)).alias("_bm"),
    ).withColumn("_in_file", F.lit(True))
    if current is None:
        current = spark.createDataFrame([], ",".join(
            f"{c} {'timestamp' if c == 'imported_at' else 'string'}" for c in ROSTER_COLS))
    c = current.select(*ROSTER_COLS).withColumn("_cur", F.lit(True))
    j = c.join(f, "email", "full")
    in_file = F.col("_in_file").isNotNull()
    return j.select(
        "email",
        *[F.when(in_file, F.col(f"_last.{k}")).otherwise(F.col(k)).alias(k)
          for k in ("name", "role", "status", "seat_tier")],
        F.when(in_file, F.coalesce("_bm", "billing_model", F.lit("seat"))).otherwise(F.col("billing_model"))
        .alias("billing_model"),
        F.when(in_file, F.lit(as_of).cast("timestamp")).otherwise(F.col("imported_at")).alias("imported_at"),
    )


def upserted_count(rows: DataFrame) -> DataFrame:
    """Rows of the file that carry an email (duplicates included)."""
    return rows.agg(F.count_if(F.col("email").isNotNull() & (F.col("email") != "")).alias("upserted"))


def validate_patches(patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K2 input check: billing_model must be seat|enterprise (any case),
    seat_tier Standard|Premium, and at least one must be given. Returns
    (accepted, rejected) with billing_model lower-cased."""
    bm = F.lower(F.col("billing_model").cast("string"))
    tier = F.col("seat_tier").cast("string")
    bad_bm = F.col("billing_model").isNotNull() & ~bm.isin(*VALID_BILLING_MODELS)
    bad_tier = tier.isNotNull() & ~tier.isin(*VALID_SEAT_TIERS)
    empty = F.col("billing_model").isNull() & tier.isNull()
    reason = (F.when(bad_bm, "bad_billing_model")
              .when(bad_tier, "bad_seat_tier")
              .when(empty, "no_fields"))
    tagged = patches.withColumn("reason", reason).withColumn("billing_model", bm)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def patch_roster(current: DataFrame | None, patches: DataFrame, as_of: dt.datetime,
                 aliases: DataFrame | None = None) -> DataFrame:
    """K2: apply accepted patches (``seq`` order) by email: each given field
    replaces the stored one, absent fields are kept; unknown emails are
    inserted (billing_model default 'seat', seat_tier NULL). An alias is
    accepted in place of the email."""
    spark = patches.sparkSession
    ok, _ = validate_patches(patches)
    if aliases is not None:
        ok = unmask(ok, "email", aliases)
    p = ok.groupBy("email").agg(
        F.max_by("billing_model", F.when(F.col("billing_model").isNotNull(), F.col("seq"))).alias("_bm"),
        F.max_by("seat_tier", F.when(F.col("seat_tier").isNotNull(), F.col("seq"))).alias("_tier"),
    ).withColumn("_in", F.lit(True))
    if current is None:
        current = spark.createDataFrame([], ",".join(
            f"{c} {'timestamp' if c == 'imported_at' else 'string'}" for c in ROSTER_COLS))
    c = current.select(*ROSTER_COLS).withColumn("_cur", F.lit(True))
    j = c.join(p, "email", "full")
    is_new = F.col("_cur").isNull()
    return j.select(
        "email", "name", "role", "status",
        F.coalesce("_tier", "seat_tier").alias("seat_tier"),
        F.coalesce("_bm", "billing_model", F.lit("seat")).alias("billing_model"),
        F.when(is_new, F.lit(as_of).cast("timestamp")).otherwise(F.col("imported_at")).alias("imported_at"),
    )


def roster_with_telemetry(requests: DataFrame, members: DataFrame, aliases: DataFrame | None = None,
                          masked: bool = False) -> DataFrame:
    """Imported members ∪ telemetry-only users (not in the roster
    case-insensitively), ordered by COALESCE(name, email)."""
    imported = members.select(
        "email", "name", "seat_tier", F.coalesce("billing_model", F.lit("seat")).alias("billing_model"),
        "status", "imported_at", F.lit("imported").alias("source"))
    lm = members.select(F.lower("email").alias("_le")).filter(F.col("_le").isNotNull())
    users = requests.select(F.col("user_email").alias("email")).filter(F.col("email").isNotNull())
    tele = users.join(lm, F.lower(users["email"]) == lm["_le"], "left_anti").select(
        "email", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("seat_tier"),
        F.lit("seat").alias("billing_model"), F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("timestamp").alias("imported_at"), F.lit("telemetry").alias("source"))
    out = imported.unionByName(tele).distinct()
    if masked:
        out = mask(out, aliases, cols=("email", "name"), key="email")
    return out.orderBy(F.coalesce("name", "email"), "email")


def roster_listing(members: DataFrame) -> DataFrame:
    """H8: the roster as listed after an import, by name (NULLs first)."""
    return members.select("email", "name", "seat_tier", "billing_model", "status", "imported_at") \
        .orderBy(F.asc_nulls_first("name"), "email")
