"""Session settings every analytic relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL confs: safe to set on a session the caller already owns.
RUNTIME_CONFS = {
    # The data model is UTC throughout (DATE(ts), hour, day-of-week).
    "spark.sql.session.timeZone": "UTC",
    # OTLP attribute maps: a repeated key keeps the last value (JS object
    # semantics); map_concat(resource, record) lets the record win.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lists of up to so many values reach the parquet readers as nested ORs, one
    # level a value, which overflow a task's stack when long; longer ones (the
    # ids of a sync batch) as one IN, which Bloom filters answer as well.
    "spark.sql.parquet.pushdown.inFilterThreshold": "10",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONFS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_session(master: str | None = None, partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the given one."""
    builder = (
        SparkSession.builder.master(master or os.environ.get("SPARK_MASTER", "local[8]"))
        .appName("usagelens")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's checkpoint folder (shared storage on a cluster).
    Only a local-mode session without one gets a private temporary folder;
    on a cluster a machine-local folder would break retries, so it is an
    error to leave ``spark.checkpoint.dir`` unset there."""
    d = checkpoint_dir(spark)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or object storage)")
        d = tempfile.mkdtemp(prefix="usagelens-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint dir (shared storage on a cluster)."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/usagelens-{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in whatever file system it names."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)
