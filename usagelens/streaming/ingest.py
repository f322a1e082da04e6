"""Continuous ingest (O1, O2, O5) with Structured Streaming.

The micro-batch body is the batch transform, unchanged. Output goes through
``foreachBatch`` into the fact tables' own layout under the name of the stream
and the batch, so a batch replayed after a failure replaces its own rows and
nothing else. The stream's name is the id Spark keeps in the checkpoint: a
second stream, or one with a fresh checkpoint, never overwrites earlier rows.
Offsets live in the checkpoint, which replaces the reference's sync high-water
mark and is only committed after the batch succeeded.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usagelens.operators.aliases import alias_number, new_aliases
from usagelens.session import configure, path_exists
from usagelens.sources import facts, folders, invocations, otlp

# Batches after which days with many small folders are merged.
COMPACT_EVERY = 16
ALIASES = "email string, alias string, created_at timestamp, ingest string"
# Beside the aliases: the highest number after each write.
NUMBERS = "_numbers"


def _trigger(writer, trigger: dict | None):
    return writer.trigger(**(trigger or {"availableNow": True}))


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark has stored in a started stream's checkpoint."""
    line = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
    return json.loads(line)["id"]


def otlp_stream(spark: SparkSession, source_dir: str, one_per_file: bool = False,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A2: payload files arriving in ``source_dir`` as a stream of
    (file, block, row, value)."""
    configure(spark)
    r = spark.readStream.format("text")
    if one_per_file:
        r = r.option("wholetext", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.load(source_dir)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


stream_otlp = otlp_stream  # A2 under its inventory name


def read_aliases(spark: SparkSession, path: str | None, without: str | None = None,
                 emails: list[str] | None = None) -> DataFrame | None:
    """All aliases stored under ``path`` (appended by one write after the
    other), without those of one ingest; None if nothing was stored yet. With
    ``emails`` only theirs: row groups whose range or Bloom filter excludes
    all of them are not read."""
    if not path or not path_exists(spark, path):
        return None
    a = spark.read.schema(ALIASES).parquet(path)
    if emails is not None:
        a = a.where(F.col("email").isin(emails))
    if without is not None:
        a = a.where(F.col("ingest") != without)
    return a.select("email", "alias", "created_at")


def highest_alias(spark: SparkSession, path: str, without: str | None = None) -> int:
    """The highest number given by any write but ``without``: as the writes have
    noted it. Only aliases of writes without a note are read."""
    root = path.rstrip("/")
    names, noted = ({folders.value(p, "ingest") for p in folders.matching(spark, f"{d}/ingest=*")} - {without}
                    for d in (root, f"{root}/{NUMBERS}"))
    highest = 0
    if noted:
        notes = spark.read.schema("highest bigint, ingest string").json(f"{root}/{NUMBERS}")
        highest = notes.where(F.col("ingest").isin(list(noted))).agg(F.max("highest")).first()[0] or 0
    if names - noted:
        others = spark.read.schema(ALIASES).parquet(root).where(F.col("ingest").isin(list(names - noted)))
        highest = max(highest, others.agg(F.max(alias_number(F.col("alias")))).first()[0] or 0)
    return highest


def append_aliases(seen: DataFrame, path: str, ingest: str, as_of: dt.datetime) -> int:
    """Aliases for the ``email``s of ``seen`` that have none, stored as the
    write ``ingest``; gives their number. One writer at a time. What is read
    follows the emails seen, not the aliases stored. The new highest number is
    noted before the aliases, so that a crash in between leaves a gap at worst,
    never a number twice; a replay replaces its own aliases and note."""
    spark, root = seen.sparkSession, path.rstrip("/")
    emails = [r[0] for r in seen.select("email").where("email is not null").distinct().limit(facts.PROBED_IDS + 1).collect()]
    stored = read_aliases(spark, path, ingest, emails if len(emails) <= facts.PROBED_IDS else None)
    highest = highest_alias(spark, path, ingest)
    added = new_aliases(seen, stored, as_of, highest=highest)
    n = added.count()
    if n or path_exists(spark, f"{root}/ingest={ingest}"):
        _counts_row(spark, {"highest": highest + n}, f"{root}/{NUMBERS}", ingest)
        w = added.repartitionByRange("email").sortWithinPartitions("email").write.mode("overwrite")
        for key, option in facts.probed_files("email", n).items():
            w = w.option(key, option)
        w.parquet(f"{root}/ingest={ingest}")
    return n


def _counts_row(spark: SparkSession, values: dict, path: str, ingest: str) -> None:
    schema = ", ".join(f"{k} bigint" for k in values)
    spark.createDataFrame([tuple(int(v) for v in values.values())], schema).coalesce(1) \
        .write.mode("overwrite").json(f"{path.rstrip('/')}/ingest={ingest}")


def otlp_batch_writer(sink_root: str, checkpoint: str, as_of: dt.datetime | None = None, alias_path: str | None = None,
                      compact_every: int | None = COMPACT_EVERY):
    """The foreachBatch body of O1 (+ O5 when ``alias_path`` is given)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        configure(spark)
        ingest = f"{stream_id(spark, checkpoint)}-{batch_id}"
        now = as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        # B20 per batch: counts gathered while the batch is first computed
        # (no extra pass), stored as one row next to the facts.
        obs = Observation(f"ingest_{batch_id}")
        ok = ~F.col("quarantined")
        counts = [F.count_if((F.col("event") == ev) & ok).alias(tb) for ev, tb in otlp.EVENTS.items()]
        known = F.coalesce(F.col("event").isin(*otlp.EVENTS), F.lit(False))
        not_json = F.coalesce(F.col("reason") == otlp.BAD_JSON, F.lit(False))
        records = otlp.flatten_otlp(batch.withColumn("row", F.monotonically_increasing_id()), now).observe(
            obs, *counts, F.count_if(~known & ok).alias("unknown"), F.count_if(~ok).alias("quarantined"),
            F.count_if(~not_json).alias("records"), F.count_if(not_json).alias("bad_payloads")).persist()
        root = sink_root.rstrip("/")
        try:
            records.count()  # materialise once; the observation fires here
            facts.write_facts(otlp.route(records), root, ingest, parallel=True)
            m = obs.get
            _counts_row(spark, {k: m[k] for k in (*otlp.EVENTS.values(), "unknown", "quarantined", "records", "bad_payloads")},
                        f"{root}/_ingest_counts", ingest)
            if m["quarantined"]:
                otlp.quarantined(records).write.mode("overwrite").parquet(f"{root}/_quarantine/ingest={ingest}")
            if alias_path:
                seen = records.filter(ok & F.col("user_email").isNotNull()).select(F.col("user_email").alias("email")).distinct()
                append_aliases(seen, alias_path, ingest, now)
        finally:
            records.unpersist()
        if compact_every and (batch_id + 1) % compact_every == 0:
            facts.compact_facts(spark, root)
    return run


def stream_ingest_otlp(spark: SparkSession, source_dir: str, sink_root: str, checkpoint: str,
                       as_of: dt.datetime | None = None, alias_path: str | None = None,
                       trigger: dict | None = None, max_files_per_trigger: int | None = None,
                       one_per_file: bool = False, compact_every: int | None = COMPACT_EVERY) -> StreamingQuery:
    """O1: payload files -> five fact tables (+ quarantine with the rejected
    text, + aliases). Every ``compact_every`` batches (None: never) days with
    many small folders are merged."""
    s = otlp_stream(spark, source_dir, one_per_file, max_files_per_trigger)
    w = s.writeStream.foreachBatch(otlp_batch_writer(sink_root, checkpoint, as_of, alias_path, compact_every)) \
        .option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def read_quarantine(spark: SparkSession, sink_root: str) -> DataFrame:
    """Everything the stream has rejected: file, reason, id, payload."""
    path = f"{sink_root.rstrip('/')}/_quarantine"
    schema = "file string, reason string, id bigint, payload string, ingest string"
    df = spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)
    return df.drop("ingest")


def invocation_batch_writer(sink_root: str, checkpoint: str, last_sync: dt.datetime | None, as_of: dt.datetime | None,
                            compact_every: int | None = COMPACT_EVERY):
    """O2 body: parse, keep, first-per-id, anti join against the stored ids
    (exact, no state expiry; of the sorted runs only row groups that may hold
    an id of this batch are read), append to the api_requests table. An error
    while reading the stored ids fails the batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        configure(spark)
        ingest = f"{stream_id(spark, checkpoint)}-{batch_id}"
        ev = invocations.parse_invocation_events(batch.withColumn("pos", F.monotonically_increasing_id()))
        if as_of is not None:
            ev = invocations.invocation_window(ev, last_sync, as_of)
        # C7 per batch: valid and inserted counts observed on the way.
        valid, inserted = Observation(f"valid_{batch_id}"), Observation(f"inserted_{batch_id}")
        kept = invocations.keep_invocations(ev)
        first = invocations.dedup_by_request_id(kept.observe(valid, F.count(F.lit(1)).alias("n")), None).persist()
        try:
            # Names of at most PROBED_IDS ids reach the scan; a larger batch reads all stored ids.
            ids = [r[0] for r in first.select("log.requestId").limit(facts.PROBED_IDS + 1).collect()]
            stored = facts.read_request_ids(spark, sink_root, ids if len(ids) <= facts.PROBED_IDS else None, without=ingest)
            new = first if stored is None else invocations.without_stored(first, stored)
            rows = invocations.invocations_to_requests(new).observe(inserted, F.count(F.lit(1)).alias("n")).persist()
            try:
                facts.write_facts({"api_requests": rows}, sink_root, ingest)
                facts.write_request_ids(rows, sink_root, ingest)
                facts.merge_request_ids(spark, sink_root)
                if compact_every and (batch_id + 1) % compact_every == 0:
                    facts.compact_facts(spark, sink_root)
                n_in = int(inserted.get["n"])
            finally:
                rows.unpersist()
            _counts_row(spark, {"inserted": n_in, "skipped": int(valid.get["n"]) - n_in},
                        f"{sink_root.rstrip('/')}/_sync_stats", ingest)
        finally:
            first.unpersist()
    return run


def stream_ingest_invocations(spark: SparkSession, source_dir: str, sink_root: str, checkpoint: str,
                              last_sync: dt.datetime | None = None, as_of: dt.datetime | None = None,
                              trigger: dict | None = None, max_files_per_trigger: int | None = None,
                              compact_every: int | None = COMPACT_EVERY) -> StreamingQuery:
    """O2: landed invocation-log files, polled on a trigger, into the
    api_requests table below ``sink_root``."""
    configure(spark)
    r = spark.readStream.schema(invocations.EVENT)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    s = r.json(source_dir).select("timestamp", "message", F.col("_metadata.file_path").alias("file"))
    w = s.writeStream.foreachBatch(invocation_batch_writer(sink_root, checkpoint, last_sync, as_of, compact_every)) \
        .option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()
