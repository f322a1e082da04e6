"""Registered streaming runs: inputs derived from the tables are landed as
files in a fresh folder under the session's checkpoint dir, streamed with
``availableNow`` (several micro-batches), and the sink is read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.plans import derived, landed
from usagelens.session import scratch_path
from usagelens.sources import facts, fixtures
from usagelens.streaming import ingest, live


def _live(spark: SparkSession, src: str, name: str, start) -> str:
    root = scratch_path(spark, name)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(src)
    start(stream, f"{root}/out", f"{root}/_checkpoint").awaitTermination()
    return f"{root}/out"


def stream_usage_windows(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    src = landed.requests_dir(spark, sf_dir, hot)
    return live.read_usage_windows(spark, _live(spark, src, "o3", live.stream_usage_windows)).drop("window_id")


def stream_daily_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.read_daily_cost(spark, _live(spark, landed.requests_dir(spark, sf_dir), "o4", live.stream_daily_cost))


_RUNS: dict = {}


def _otlp_ingested(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """One ingest stream per session (five fact tables, quarantine, aliases);
    the streaming queries below read its outputs."""
    key = (fixtures.session_key(spark), sf_dir)
    if key not in _RUNS:
        src = landed.otlp_payload_dir(spark, sf_dir)
        root = scratch_path(spark, "o1")
        q = ingest.stream_ingest_otlp(spark, src, f"{root}/facts", f"{root}/_checkpoint", as_of=fixtures.AS_OF,
                                      alias_path=f"{root}/aliases", max_files_per_trigger=4)
        q.awaitTermination()
        _RUNS[key] = (f"{root}/facts", f"{root}/aliases")
    return _RUNS[key]


def stream_otlp_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    root, _ = _otlp_ingested(spark, sf_dir)
    return facts.read_fact(spark, root, name).drop("id", "ingest_seq")


def stream_otlp_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = _otlp_ingested(spark, sf_dir)
    return ingest.read_quarantine(spark, root)


def ingested_tables(spark: SparkSession, sf_dir: str):
    root, _ = _otlp_ingested(spark, sf_dir)
    return facts.load_stored_tables(spark, root)


def stream_alias_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored alias, whether it is unique, and whether the numbers run
    from 1 without a gap."""
    _, alias_path = _otlp_ingested(spark, sf_dir)
    a = ingest.read_aliases(spark, alias_path)
    number = F.regexp_extract("alias", r"^USER-([1-9][0-9]*)$", 1).try_cast("bigint")
    span = a.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("alias").alias("d"), F.min(number).alias("lo"), F.max(number).alias("hi"))
    valid = (F.col("d") == F.col("n")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))
    whole = span.select(F.lit(1).alias("one"), valid.alias("valid"))  # one row
    return a.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one").select("email", "valid")


def _synced(spark: SparkSession, sf_dir: str) -> str:
    """Facts with some request ids stored before, then one sync stream."""
    key = ("o2", fixtures.session_key(spark), sf_dir)
    if key not in _RUNS:
        t = fixtures.load_tables(spark, sf_dir)
        src = landed.invocation_log_dir(spark, sf_dir)
        root = scratch_path(spark, "o2")
        sink = f"{root}/facts"
        facts.write_request_ids(derived.stored_request_ids(t), sink, "before")
        ingest.stream_ingest_invocations(
            spark, src, sink, f"{root}/_checkpoint", last_sync=dt.datetime.fromisoformat(derived.SYNC_FROM),
            as_of=fixtures.AS_OF, max_files_per_trigger=12).awaitTermination()
        _RUNS[key] = sink
    return _RUNS[key]


def stream_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.read_fact(spark, _synced(spark, sf_dir), "api_requests").select(
        "timestamp", "user_email", "model", "cost_usd", "input_tokens", "output_tokens", "source", "aws_request_id")


def synced_tables(spark: SparkSession, sf_dir: str):
    return facts.load_stored_tables(spark, _synced(spark, sf_dir))
