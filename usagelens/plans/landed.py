"""Derived inputs landed once per session as files under the session's
checkpoint folder (shared storage on a cluster), then read back through the
real file readers. Later queries of the same session reuse the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.plans import derived
from usagelens.session import scratch_path
from usagelens.sources import fixtures

_LANDED: dict = {}
# A payload file holds at most about so many events.
EVENTS_PER_FILE = 1_000_000


def _tasks(spark: SparkSession) -> int:
    """Files to land: they follow the cluster, and some streams need several."""
    return max(8, spark.sparkContext.defaultParallelism)


def _land(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    key = (fixtures.session_key(spark), sf_dir, name)
    if key not in _LANDED:
        path = scratch_path(spark, f"landed-{name}")
        write(fixtures.load_tables(spark, sf_dir), path)
        _LANDED[key] = path
    return _LANDED[key]


def otlp_payload_dir(spark: SparkSession, sf_dir: str) -> str:
    """NDJSON files, one OTLP payload per line, in the order of the rows' ids."""
    def write(t, path):
        files = max(_tasks(spark), -(-t.extra["events"].count() // EVENTS_PER_FILE))
        # The rows come sorted: payloads are put together as they are read, none is held.
        in_order = "spark.sql.execution.replaceHashWithSortAgg"
        before = spark.conf.get(in_order)
        spark.conf.set(in_order, "true")
        try:
            derived.otlp_payloads(t, files).select("value").write.text(path)
        finally:
            spark.conf.set(in_order, before)
    return _land(spark, sf_dir, "otlp", write)


def invocation_log_dir(spark: SparkSession, sf_dir: str) -> str:
    """JSON-lines log events, one folder per day."""
    def write(t, path):
        ev = derived.invocation_events(t)
        ev.select("timestamp", "message", F.to_date(F.timestamp_millis("timestamp")).alias("day")) \
            .hint("rebalance", F.col("day")).write.partitionBy("day").json(path)
    return _land(spark, sf_dir, "invocations", write)


def usage_report_dir(spark: SparkSession, sf_dir: str) -> str:
    """date=YYYY-MM-DD folders, one JSON page per line."""
    def write(t, path):
        derived.usage_pages(t).hint("rebalance", F.col("date")).write.partitionBy("date").text(path)
    return _land(spark, sf_dir, "usage-report", write)


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct telemetry emails with their user number (parquet)."""
    def write(t, path):
        derived.identities(t).write.parquet(path)
    return spark.read.parquet(_land(spark, sf_dir, "identities", write))


FACT_WRITES = 3


def _dealt_base(t, path: str) -> DataFrame:
    """The parsed events, landed once and dealt by a hash of their ids (``part``):
    the writes of the facts read their own part and parse nothing again."""
    b = t.extra["base"].withColumn("part", F.pmod(F.xxhash64("id"), F.lit(FACT_WRITES)))
    b.write.partitionBy("part").parquet(path)
    return b.sparkSession.read.schema(b.schema).parquet(path)


def facts_root(spark: SparkSession, sf_dir: str) -> str:
    """The fact tables in the sink's layout, with rollups: one write, the rollups
    built from it, then two more with rows of the same (by then past) days; compacted
    after the second."""
    from usagelens import schemas
    from usagelens.sources import facts

    def write(t, path):
        base = _dealt_base(t, scratch_path(spark, "landed-base"))
        for part in range(FACT_WRITES):
            own = base.where(F.col("part") == part).drop("part")
            rows = {n: getattr(fixtures, n)(own) for n in schemas.FACTS}
            facts.write_facts(rows, path, f"w{part}", parallel=True)
            if part == 0:
                facts.build_rollups(spark, path)
            if part == 1:
                facts.compact_facts(spark, path, min_writes=2)
    return _land(spark, sf_dir, "facts", write)


HOT_USER = "hot@example.com"


def requests_dir(spark: SparkSession, sf_dir: str, hot: bool = False) -> str:
    """api_requests (the columns the live queries use) in files without any
    time order, so that most rows of a stream over them are late; ``hot``: one
    user holds a third of the rows."""
    def write(t, path):
        cols = ["id", "timestamp", "user_email", "cost_usd", "input_tokens", "output_tokens"]
        r = t.api_requests.select(*cols)
        if hot:
            r = r.withColumn("user_email", F.when(F.col("id") % 3 == 0, F.lit(HOT_USER)).otherwise(F.col("user_email")))
        r.repartition(_tasks(spark), "id").write.parquet(path)
    return _land(spark, sf_dir, f"requests-{hot}", write)


def roster_csv_dir(spark: SparkSession, sf_dir: str) -> str:
    """Roster CSV files, imported in the order of their names."""
    def write(t, path):
        derived.roster_lines(t, identities(spark, sf_dir)).repartitionByRange("file").sortWithinPartitions("file", "line") \
            .select("file", "value").write.partitionBy("file").text(path)
    return _land(spark, sf_dir, "roster", write)
