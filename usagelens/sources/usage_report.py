"""A5: landed per-user usage-report pages.

Layout: ``<root>/date=YYYY-MM-DD/<page>.json``, one JSON page per file:
``{data: [{actor: {email_address}, model_breakdown: [{tokens: {input,
output, cache_read}, estimated_cost: {amount}}]}], has_more, next_page}``.
A day without files (a failed fetch in the reference) simply has no rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BREAKDOWN = T.StructType([
    T.StructField("tokens", T.StructType([
        T.StructField("input", T.LongType()), T.StructField("output", T.LongType()),
        T.StructField("cache_read", T.LongType())])),
    T.StructField("estimated_cost", T.StructType([T.StructField("amount", T.DoubleType())])),
])
RECORD = T.StructType([
    T.StructField("actor", T.StructType([T.StructField("email_address", T.StringType())])),
    T.StructField("model_breakdown", T.ArrayType(BREAKDOWN)),
])
PAGE = T.StructType([
    T.StructField("data", T.ArrayType(RECORD)),
    T.StructField("has_more", T.BooleanType()),
    T.StructField("next_page", T.StringType()),
])


def parse_usage_pages(pages: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """(date, value) pages -> one row per record: (date, email, tokens,
    cents). Per-record sums are taken inside the record (``aggregate``),
    so exploding never multiplies records."""
    if start is not None and end is not None:
        pages = pages.filter((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end)))
    recs = pages.select("date", F.explode(F.from_json("value", PAGE)["data"]).alias("r"))
    mb = F.coalesce(F.col("r.model_breakdown"), F.array().cast(T.ArrayType(BREAKDOWN)))
    return recs.select(
        "date",
        F.col("r.actor.email_address").alias("email"),
        F.aggregate(mb, F.lit(0).cast("bigint"), lambda acc, m: acc + F.coalesce(m["tokens"]["input"], F.lit(0))
                    + F.coalesce(m["tokens"]["output"], F.lit(0)) + F.coalesce(m["tokens"]["cache_read"], F.lit(0)))
        .alias("tokens"),
        F.aggregate(mb, F.lit(0.0), lambda acc, m: acc + F.coalesce(m["estimated_cost"]["amount"], F.lit(0.0)))
        .alias("cents"),
    )


def read_usage_report(spark: SparkSession, root: str, start: dt.date, end: dt.date,
                      one_page_per_file: bool = True) -> DataFrame:
    """Pages under ``root`` for days in [start, end); the date predicate
    prunes the date= partitions. Pages are whole files (as fetched) or, with
    ``one_page_per_file=False``, one JSON page per line."""
    reader = spark.read.option("wholetext", True) if one_page_per_file else spark.read
    pages = reader.text(root).withColumn("date", F.col("date").cast("date"))
    return parse_usage_pages(pages, start, end)
