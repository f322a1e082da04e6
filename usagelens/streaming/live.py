"""Live analytics over a request stream.

A stream keeps small pre-aggregates: per (user, time bucket one gap wide) for
the gap windows, per day for the daily cost. Rows are combined before the
shuffle and the state has a row per bucket, whatever a user's number of
requests, so a user (or the NULL user) with a third of all rows is no hot key.
Changed buckets are written under the batch's number. Every ``SNAPSHOT_EVERY``
batches the newest version of each bucket is written as a snapshot, moved to its
place in one rename, and what it covers is deleted; so a sink holds a snapshot
and a bounded number of batches, whatever the age of the stream. Reading takes
the newest snapshot, the batches after it, and of each bucket the newest
version; batches a snapshot covers are passed over, so neither a crash before
their deletion nor a replay changes the result. There is no watermark: a row
counts whenever it arrives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usagelens.operators import windows
from usagelens.operators.windows import SESSION_GAP_SECONDS
from usagelens.session import configure, path_exists
from usagelens.sources import folders
from usagelens.streaming.ingest import _trigger, stream_id

BUCKET, DAY = ["user_email", "bucket"], ["day"]
# Batches a sink holds before they become a snapshot.
SNAPSHOT_EVERY = 16


def _start(rollup: DataFrame, keys: list[str], sink: str, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    """Write every batch's changed rows to ``sink/stream=S/batch=N``. A sink
    belongs to one stream: its state is the sum of all it has read."""
    def run(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        name = stream_id(spark, checkpoint)
        mine = f"{sink.rstrip('/')}/stream={name}"
        if path_exists(spark, sink) and not path_exists(spark, mine):
            raise ValueError(f"{sink} holds the result of another stream")
        new = folders.aside(mine)
        changed.write.parquet(new)
        folders.discard(spark, f"{mine}/batch={batch_id}")
        folders.move(spark, new, f"{mine}/batch={batch_id}")
        if len(folders.matching(spark, f"{mine}/batch=*")) >= SNAPSHOT_EVERY:
            snapshot(spark, sink, keys)

    configure(rollup.sparkSession)
    w = rollup.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def _parts(spark: SparkSession, sink: str) -> tuple[list[tuple[int, str]], list[str]]:
    """((number, folder) of the newest snapshot and the batches after it, the
    folders these replace)."""
    base = sink.rstrip("/")
    snaps, batches = ([(int(folders.value(p, kind)), p) for p in folders.matching(spark, f"{base}/stream=*/{kind}=*")]
                      for kind in ("snapshot", "batch"))
    last = max(snaps, default=None)
    current = [last] if last else []
    current += [b for b in batches if last is None or b[0] > last[0]]
    kept = {p for _, p in current}
    return current, [p for _, p in snaps + batches if p not in kept]


def _newest(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    current, _ = _parts(spark, sink)
    schema = spark.read.parquet(current[-1][1]).schema
    rows = [spark.read.schema(schema).parquet(p).withColumn("batch", F.lit(n).cast("bigint")) for n, p in current]
    rows = reduce(DataFrame.unionByName, rows)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return best.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def snapshot(spark: SparkSession, sink: str, keys: list[str]) -> None:
    """Replace the sink's batches by one snapshot of the newest versions."""
    current, replaced = _parts(spark, sink)
    number, path = max(current)
    mine = path.rsplit("/", 1)[0]
    if not path.endswith(f"/snapshot={number}"):
        new = folders.aside(mine)
        _newest(spark, sink, keys).write.parquet(new)
        folders.move(spark, new, f"{mine}/snapshot={number}")
        replaced += [p for _, p in current]
    for p in replaced:
        folders.discard(spark, p)


def stream_usage_windows(requests: DataFrame, sink: str, checkpoint: str, gap_seconds: int = SESSION_GAP_SECONDS,
                         trigger: dict | None = None) -> StreamingQuery:
    """O3: keep the buckets of the gap windows for a streaming request table."""
    return _start(windows.buckets(requests, gap_seconds), BUCKET, sink, checkpoint, trigger)


def read_usage_windows(spark: SparkSession, sink: str, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """O3: the gap windows of everything the stream has read so far."""
    return windows.bucket_windows(_newest(spark, sink, BUCKET), gap_seconds)


def stream_daily_cost(requests: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """E2 per UTC day over a stream."""
    daily = requests.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.sum("cost_usd").alias("cost"), F.sum("input_tokens").cast("bigint").alias("input_tokens"),
        F.sum("output_tokens").cast("bigint").alias("output_tokens"), F.count(F.lit(1)).alias("requests"))
    return _start(daily, DAY, sink, checkpoint, trigger)


def read_daily_cost(spark: SparkSession, sink: str) -> DataFrame:
    """The daily sums of everything the stream has read so far."""
    return _newest(spark, sink, DAY)
