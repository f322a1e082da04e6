"""Model-invocation logs.

Input: landed log events, one JSON object per line ``{timestamp: epoch ms,
message: "<JSON text>"}``. The message is parsed with a fixed schema; a
message that is not JSON parses to all-NULL fields and is dropped by the
schema/operation filter, as the reference skips it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.functions.models import arn_user, backfill_model_id, list_price, normalize_model

EVENT = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("message", T.StringType())])
MESSAGE = T.StructType([
    T.StructField("schemaType", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("requestId", T.StringType()),
    T.StructField("modelId", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("identity", T.StructType([T.StructField("arn", T.StringType())])),
    T.StructField("input", T.StructType([T.StructField("inputTokenCount", T.LongType())])),
    T.StructField("output", T.StructType([T.StructField("outputTokenCount", T.LongType())])),
])
DEFAULT_LOOKBACK = dt.timedelta(hours=24)


def read_invocation_logs(spark: SparkSession, path: str) -> DataFrame:
    """A3: events with their file and line position (for first-wins)."""
    ev = spark.read.schema(EVENT).json(path)
    # Tie-break for events with equal time: file, then a position that is
    # deterministic for a given set of files (a retried task recomputes it).
    ev = ev.select("timestamp", "message", F.col("_metadata.file_path").alias("file"),
                   F.monotonically_increasing_id().alias("pos"))
    return parse_invocation_events(ev)


def parse_invocation_events(events: DataFrame) -> DataFrame:
    """(timestamp, message, file, pos) -> + parsed ``log`` struct.

    The struct comes out of a generator (explode of a one-element array):
    filters on ``log.*`` then stay above it, so each message is parsed once.
    From a plain projection the optimizer would push those filters below it
    and inline ``from_json`` into every predicate (one parse per test)."""
    return events.select("*", F.explode(F.array(F.from_json("message", MESSAGE))).alias("log"))


def invocation_window(events: DataFrame, last_sync: dt.datetime | None, as_of: dt.datetime) -> DataFrame:
    """A4: events in [last_sync or as_of - 24h, as_of] by event time."""
    lo = last_sync or (as_of - DEFAULT_LOOKBACK)
    ms = lambda d: int(d.replace(tzinfo=dt.timezone.utc).timestamp() * 1000) if d.tzinfo is None \
        else int(d.timestamp() * 1000)
    return events.filter(F.col("timestamp").between(ms(lo), ms(as_of)))


def keep_invocations(events: DataFrame) -> DataFrame:
    """InvokeModel records of the invocation-log schema with a request id."""
    return events.filter(
        (F.col("log.schemaType") == "ModelInvocationLog") & (F.col("log.operation") == "InvokeModel")
        & F.col("log.requestId").isNotNull() & (F.col("log.requestId") != ""))


def new_ids_only(new: DataFrame, stored_ids: DataFrame, key: str = "aws_request_id") -> DataFrame:
    """Rows whose request id is not stored yet (anti join)."""
    s = stored_ids.select(F.col(key).alias("_rid")).filter(F.col("_rid").isNotNull())
    return new.join(s, new[key] == F.col("_rid"), "left_anti")


def dedup_by_request_id(new: DataFrame, stored_ids: DataFrame | None) -> DataFrame:
    """First event per request id (event time, file, position), and
    only ids not stored already (an anti join; exact, no state expiry)."""
    w = Window.partitionBy(F.col("log.requestId")).orderBy("timestamp", "file", "pos")
    first = new.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return first if stored_ids is None else without_stored(first, stored_ids)


def without_stored(events: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Parsed events whose request id is not stored yet."""
    s = stored_ids.select(F.col("aws_request_id").alias("_rid")).filter(F.col("_rid").isNotNull())
    return events.join(s, F.col("log.requestId") == F.col("_rid"), "left_anti")


def log_time(text) -> F.Column:
    """The log's own time: ISO 8601 or the HTTP date form; anything else is
    NULL (the event's time then counts)."""
    http = F.regexp_replace(text, "^[A-Za-z]{3}, ", "")
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(text, "Z$", "")),
                      F.try_to_timestamp(http, F.lit("dd MMM yyyy HH:mm:ss 'GMT'")))


def invocations_to_requests(events: DataFrame) -> DataFrame:
    """api_requests rows (source 'bedrock'); tokens default to 0,
    the log's own timestamp wins over the event's."""
    tin = F.coalesce(F.col("log.input.inputTokenCount"), F.lit(0)).cast("bigint")
    tout = F.coalesce(F.col("log.output.outputTokenCount"), F.lit(0)).cast("bigint")
    model = normalize_model(F.col("log.modelId"))
    log_ts = F.nullif(F.col("log.timestamp"), F.lit(""))
    ts = F.coalesce(log_time(log_ts), F.timestamp_millis("timestamp"))
    return events.select(
        F.xxhash64("file", "message", F.col("log.requestId")).alias("id"),
        ts.alias("timestamp"),
        arn_user(F.col("log.identity.arn")).alias("user_email"),
        model.alias("model"),
        list_price(model, tin, tout).alias("cost_usd"),
        tin.alias("input_tokens"),
        tout.alias("output_tokens"),
        F.lit("bedrock").alias("source"),
        F.col("log.requestId").alias("aws_request_id"),
    )


def sync_invocations(events: DataFrame, stored_ids: DataFrame | None, last_sync: dt.datetime | None,
                     as_of: dt.datetime) -> DataFrame:
    """A4 + C1 + C2 + C6: the rows one sync inserts."""
    kept = keep_invocations(invocation_window(events, last_sync, as_of))
    if stored_ids is not None:
        stored_ids = stored_ids.select("aws_request_id")
    return invocations_to_requests(dedup_by_request_id(kept, stored_ids))


def sync_stats(events: DataFrame, stored_ids: DataFrame | None, last_sync: dt.datetime | None,
               as_of: dt.datetime) -> DataFrame:
    """Inserted / skipped counts of one sync: inserted = distinct ids not
    stored yet, skipped = the other valid records (stored or repeated). One
    aggregation; the distinct count is partially aggregated before its
    shuffle, so a hot id does not concentrate in one task."""
    kept = keep_invocations(invocation_window(events, last_sync, as_of)).select(F.col("log.requestId").alias("rid"))
    if stored_ids is not None:
        s = (stored_ids.select(F.col("aws_request_id").alias("_rid"))
                              .filter(F.col("_rid").isNotNull()).distinct())
        kept = kept.join(s, F.col("rid") == F.col("_rid"), "left")
    else:
        kept = kept.withColumn("_rid", F.lit(None).cast("string"))
    counts = kept.agg(F.count(F.lit(1)).alias("_valid"),
                      F.countDistinct(F.when(F.col("_rid").isNull(), F.col("rid"))).alias("inserted"))
    return counts.select("inserted", (F.col("_valid") - F.col("inserted")).alias("skipped"))


def backfill_model_ids(requests: DataFrame) -> DataFrame:
    """Rewrite stored model ids (sequential case-insensitive strips)."""
    return requests.withColumn("model", backfill_model_id(F.col("model")))
