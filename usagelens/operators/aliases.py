"""Pseudonymisation: alias assignment (USER-n), masking and identities."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.params import Tables
from usagelens.session import ensure_checkpoint_dir

ALIAS_PREFIX = "USER-"


def all_identities(t: Tables) -> DataFrame:
    """I4: distinct non-null emails over the five fact tables."""
    out = None
    for df in (t.api_requests, t.tool_uses, t.user_prompts, t.api_errors, t.tool_decisions):
        e = df.select(F.col("user_email").alias("email")).filter(F.col("email").isNotNull())
        out = e if out is None else out.unionByName(e)
    return out.distinct()


def alias_number(alias_col) -> F.Column:
    return F.substring(alias_col, len(ALIAS_PREFIX) + 1, 1 << 30).try_cast("bigint")


def assign_aliases(
    identities: DataFrame, current: DataFrame | None, as_of: dt.datetime, n_ranges: int | None = None
) -> DataFrame:
    """L1: aliases for emails that have none, USER-(max+1).. in email order;
    existing aliases are kept. Returns the full alias table."""
    added = new_aliases(identities, current, as_of, n_ranges)
    if current is None:
        return added
    return current.select("email", "alias", "created_at").unionByName(added)


def new_aliases(
    identities: DataFrame, current: DataFrame | None, as_of: dt.datetime, n_ranges: int | None = None,
    highest: int | None = None,
) -> DataFrame:
    """The aliases L1 adds to ``current``. With ``highest``, the number to go on
    from, ``current`` need only hold the aliases of ``identities``.

    Numbering is a global rank, computed without a single-task window:
    range-partition the new emails, checkpoint (so the ranges are stable if
    a task is retried), count per range, turn the counts into offsets (one
    row per range), and rank within each range.
    """
    spark = identities.sparkSession
    ensure_checkpoint_dir(spark)
    new = identities.select("email").filter(F.col("email").isNotNull()).distinct()
    if current is not None:
        new = new.join(current.select("email"), "email", "left_anti")
    if highest is not None:
        start = spark.createDataFrame([(-1, highest)], "_range int, _n bigint")
    elif current is not None:
        # The running sum below starts from the highest existing number.
        start = current.agg(
            F.lit(-1).alias("_range"),
            F.coalesce(F.max(alias_number(F.col("alias"))), F.lit(0)).cast("bigint").alias("_n"),
        )
    else:
        start = spark.createDataFrame([(-1, 0)], "_range int, _n bigint")
    n = n_ranges or spark.sparkContext.defaultParallelism
    ranged = (
        new.repartitionByRange(n, "email")
        .withColumn("_range", F.spark_partition_id())
        .checkpoint(eager=True)
    )
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).unionByName(start)
    # One row per range (plus the start row): a tiny single-partition window.
    offsets = counts.select(
        "_range",
        F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_off"),
    ).filter(F.col("_range") >= 0)
    local = ranged.withColumn("_pos", F.row_number().over(Window.partitionBy("_range").orderBy("email")))
    numbered = local.join(F.broadcast(offsets), "_range")
    return numbered.select(
        "email",
        F.concat(F.lit(ALIAS_PREFIX), (F.col("_off") + F.col("_pos")).cast("string")).alias("alias"),
        F.lit(as_of).cast("timestamp").alias("created_at"),
    )


def mask(
    df: DataFrame, aliases: DataFrame | None, cols=("user_email",), key: str = "user_email", strict: bool = False
) -> DataFrame:
    """L2/L3: replace ``cols`` by the alias of the ``key`` column. Unknown
    emails pass through in clear (fail-open, as the reference), or become
    NULL with ``strict=True``."""
    if aliases is None:
        return df
    a = aliases.select(F.col("email").alias("_m_email"), F.col("alias").alias("_m_alias"))
    j = df.join(a, F.col(key) == F.col("_m_email"), "left")
    alias = F.col("_m_alias")
    for c in cols:
        if c in df.columns:
            j = j.withColumn(c, alias if strict else F.coalesce(alias, F.col(c)))
    return j.drop("_m_email", "_m_alias")


def alias_lookup(df: DataFrame, aliases: DataFrame, key: str = "user_email") -> DataFrame:
    """Each row with the alias of its ``key`` column (NULL if none)."""
    a = aliases.select(F.col("email").alias("_l_email"), F.col("alias"))
    return df.join(a, F.col(key) == F.col("_l_email"), "left").drop("_l_email")
