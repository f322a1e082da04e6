"""The fact-table sink and additive schema alignment.

One layout for batch and streaming writers: ``table/event_date=D/ingest=K``.
``ingest`` names the write (a stream and its batch, or one batch call), so a
replayed write replaces exactly its own folders and writers never touch each
other's. ``event_date`` is outermost, so time filters prune whole days.

``compact_facts`` merges the folders of a day into one, ``ingest=compacted-N``,
whose rows keep the name of their write in ``origin``. Two rules make every
state in between readable: of several compacted folders of a day only the one
with the largest N counts, and a folder ``ingest=K`` takes the place of the
compacted rows with origin K. So a crash between writing and deleting shows no
row twice, and a batch replayed after its compaction changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens import schemas
from usagelens.operators.rollups import HOURLY
from usagelens.session import configure, path_exists
from usagelens.sources import folders

PARTITIONS = T.StructType([T.StructField("event_date", T.DateType()), T.StructField("ingest", T.StringType())])
ORIGIN = T.StructField("origin", T.StringType())
COMPACTED = "compacted-"
# Folders of a day from which on they are merged into one.
MIN_WRITES = 8

ID_INDEX = T.StructType([T.StructField("aws_request_id", T.StringType()), T.StructField("ingest", T.StringType())])
# Runs of a level that are merged into one of the next level.
MERGED_RUNS = 8
# A batch of at most so many ids names them to the scan (session.py lets lists of
# this length reach the readers); a larger one is joined with all stored ids.
PROBED_IDS = 10_000


def probed_files(column: str, values: int) -> dict[str, str]:
    """Options of sorted files that are asked for single values of ``column``:
    small row groups, with a Bloom filter tight enough that thousands of unknown
    values still skip nearly all of them. ``values``: distinct ones to expect."""
    return {f"parquet.bloom.filter.enabled#{column}": "true", f"parquet.bloom.filter.fpp#{column}": "0.0000001",
            f"parquet.bloom.filter.expected.ndv#{column}": str(min(max(values, 1), 200_000)), "parquet.block.size": str(8 << 20)}


ID_FILES = probed_files("aws_request_id", 200_000)


def align_schema(df: DataFrame, schema: T.StructType, extra: tuple[str, ...] = ()) -> DataFrame:
    """Add missing columns as NULL and cast to the declared types, in
    declared order (older files lack later-added columns); ``extra``
    columns are kept as they are."""
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols, *[F.col(c) for c in extra if c in df.columns])


def new_ingest() -> str:
    return f"batch-{uuid.uuid4().hex[:16]}"


def _write(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace the partitions that ``df`` holds. The rows are rebalanced by the
    first partition column: few files where a value is small, several tasks
    where it is large."""
    df.hint("rebalance", F.col(partitions[0])).write.partitionBy(*partitions).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_facts(tables: dict[str, DataFrame], root: str, ingest: str | None = None, parallel: bool = False) -> str:
    """One parquet table per fact. ``ingest`` names this write (default: a
    new name); the same name again replaces the earlier write's days. With
    ``parallel`` the independent table writes are submitted as concurrent jobs
    (useful when one batch is too small to fill the cluster). A root with
    rollups (``build_rollups``) gets those of the written rows as well."""
    ingest = ingest or new_ingest()
    first = next(iter(tables.values()), None)
    if first is not None and has_rollups(first.sparkSession, root):
        tables = tables | {roll: sums(align_schema(tables[fact], schemas.FACTS[fact])) for roll, (fact, sums) in HOURLY.items() if fact in tables}

    def write(item):
        name, df = item
        out = align_schema(df, schemas.STORED[name])
        out = out.withColumn("event_date", F.to_date("timestamp")).withColumn("ingest", F.lit(ingest))
        _write(out, f"{root.rstrip('/')}/{name}", "event_date", "ingest")

    if not parallel:
        for item in tables.items():
            write(item)
        return ingest
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        for f in [pool.submit(write, item) for item in tables.items()]:
            f.result()  # re-raises the first failure; the batch is then replayed
    return ingest


def _writes(spark: SparkSession, path: str) -> dict[str | None, list[str]]:
    """The folders of a fact table: day -> names of its writes."""
    out: dict[str | None, list[str]] = {}
    for p in folders.matching(spark, f"{path}/event_date=*/ingest=*"):
        out.setdefault(folders.value(p, "event_date"), []).append(folders.value(p, "ingest"))
    return out


def _among(column: str, values: list[str]) -> str:
    """SQL: whether a column is one of the texts."""
    quoted = ("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return f"{column} IN ({', '.join(quoted)})" if values else "false"


def _hidden(writes: dict[str | None, list[str]]):
    """The rows that the rules of compaction leave out, as a condition; None if
    there are none. Names only days with folders besides their compacted one,
    days with the same folders together."""
    alike: dict[tuple[str, ...], list[str | None]] = {}
    for day, names in writes.items():
        if len(names) > 1 and any(n.startswith(COMPACTED) for n in names):
            alike.setdefault(tuple(sorted(names)), []).append(day)
    rules = []
    for names, days in alike.items():
        *older, newest = [n for n in names if n.startswith(COMPACTED)]
        others = [n for n in names if not n.startswith(COMPACTED)]
        dated = _among("CAST(event_date AS STRING)", [d for d in days if d is not None]) + (" OR event_date IS NULL" if None in days else "")
        rules.append(f"({dated}) AND ({_among('ingest', older)} OR ({_among('ingest', [newest])} AND {_among('origin', others)}))")
    return F.expr(" OR ".join(f"({r})" for r in rules)) if rules else None


def _stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The current rows of a fact table with event_date, ingest and origin."""
    schema = T.StructType([*schemas.STORED[name].fields, ORIGIN, *PARTITIONS.fields])
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    hidden = _hidden(_writes(spark, path))
    df = spark.read.schema(schema).parquet(path)
    return df if hidden is None else df.where(~F.coalesce(hidden, F.lit(False)))


def read_fact(spark: SparkSession, root: str, name: str, keep_partition_date: bool = False) -> DataFrame:
    """A stored fact table, read with its declared schema (no footer is opened
    for it; columns that older files lack are NULL). A table nothing was
    written to is empty. With ``keep_partition_date`` the ``event_date``
    partition column stays, so time filters prune partitions."""
    df = _stored(spark, f"{root.rstrip('/')}/{name}", name)
    return align_schema(df, schemas.STORED[name], extra=("event_date",) if keep_partition_date else ())


def stored_days(spark: SparkSession, root: str, name: str) -> list[str]:
    """Days (ISO dates, newest first) a fact table has folders for; rows without
    a time lie outside any day."""
    days = {folders.value(p, "event_date") for p in folders.matching(spark, f"{root.rstrip('/')}/{name}/event_date=*")}
    return sorted(days - {None}, reverse=True)


def has_rollups(spark: SparkSession, root: str) -> bool:
    return path_exists(spark, f"{root.rstrip('/')}/hourly_requests")


def build_rollups(spark: SparkSession, root: str) -> None:
    """Hourly rollups of all facts stored below ``root``, under the names of the
    writes they sum up. From then on every write adds its own. To be run while
    nothing else writes there; again after a failure."""
    for roll, (fact, sums) in HOURLY.items():   # hourly_requests, the sign that all are there, comes last
        rows = _stored(spark, f"{root.rstrip('/')}/{fact}", fact).withColumn("ingest", F.coalesce("origin", "ingest"))
        out = align_schema(sums(rows, "ingest"), schemas.ROLLUPS[roll], extra=("ingest",))
        _write(out.withColumn("event_date", F.to_date("timestamp")), f"{root.rstrip('/')}/{roll}", "event_date", "ingest")


def compact_facts(spark: SparkSession, root: str, names: tuple[str, ...] | None = None, min_writes: int = MIN_WRITES) -> dict[str, int]:
    """Merge the folders of every day that has ``min_writes`` or more into one,
    in files that follow the bytes of the day, sorted by time. Days per table.
    One job of this kind at a time may work on a table; writers may go on, but a
    read that is under way when its files go has to be repeated."""
    done = {}
    for name in names or (*schemas.FACTS, *(schemas.ROLLUPS if has_rollups(spark, root) else ())):
        path = f"{root.rstrip('/')}/{name}"
        writes = {d: ks for d, ks in _writes(spark, path).items() if len(ks) >= min_writes}
        done[name] = len(writes)
        if not writes:
            continue
        dated = F.col("event_date").cast("string").isin([d for d in writes if d is not None])
        rows = _stored(spark, path, name).where(dated | F.col("event_date").isNull() if None in writes else dated)
        new = folders.aside(path)
        (rows.withColumn("origin", F.coalesce("origin", "ingest")).drop("ingest").hint("rebalance", F.col("event_date"))
         .sortWithinPartitions("event_date", "timestamp").write.partitionBy("event_date").parquet(new))
        for p in folders.matching(spark, f"{new}/event_date=*"):
            day = p.rsplit("/", 1)[1]
            names_ = writes[folders.value(p, "event_date")]
            last = max((int(n[len(COMPACTED):]) for n in names_ if n.startswith(COMPACTED)), default=0)
            folders.move(spark, p, f"{path}/{day}/ingest={COMPACTED}{last + 1:09d}")
            for n in names_:
                folders.discard(spark, f"{path}/{day}/ingest={n}")
        folders.discard(spark, new)
    return done


def load_stored_tables(spark: SparkSession, facts_root: str, dims: dict | None = None):
    """Tables over the sink's fact tables (partition pruning enabled) plus
    optional dimension DataFrames (org_members, user_aliases, teams,
    team_members)."""
    from usagelens.params import Tables

    configure(spark)
    f = {n: read_fact(spark, facts_root, n, keep_partition_date=True) for n in schemas.FACTS}
    extra = {"days": sorted({d for n in schemas.FACTS for d in stored_days(spark, facts_root, n)}, reverse=True)}
    if has_rollups(spark, facts_root):
        extra["rollups"] = {n: read_fact(spark, facts_root, n, keep_partition_date=True) for n in schemas.ROLLUPS}
    return Tables(**f, **(dims or {}), extra=extra)


# ── ids of synced requests ──────────────────────────────────────────────────
def _write_run(rows: DataFrame, root: str, run: str, replace: bool = False) -> None:
    """One sorted run of ids. ``replace``: a run of this name may be there."""
    spark, path = rows.sparkSession, f"{root.rstrip('/')}/_request_ids"
    new = folders.aside(path)
    w = rows.select(*ID_INDEX.names).repartitionByRange("aws_request_id").sortWithinPartitions("aws_request_id").write
    for key, option in ID_FILES.items():
        w = w.option(key, option)
    w.parquet(new)
    if replace:
        folders.discard(spark, f"{path}/run={run}")
    folders.move(spark, new, f"{path}/run={run}")


def write_request_ids(ids: DataFrame, root: str, ingest: str) -> None:
    """Note the request ids (``aws_request_id``) that ``ingest`` has stored: a run
    of level 0, which the same ingest replaces."""
    rows = ids.select("aws_request_id", F.lit(ingest).alias("ingest")).where("aws_request_id is not null")
    _write_run(rows, root, f"0-{ingest}", replace=True)


def id_runs(spark: SparkSession, root: str) -> dict[int, list[str]]:
    """The runs of stored ids by level."""
    out: dict[int, list[str]] = {}
    for p in folders.matching(spark, f"{root.rstrip('/')}/_request_ids/run=*"):
        out.setdefault(int(folders.value(p, "run").split("-", 1)[0]), []).append(p)
    return out


def merge_request_ids(spark: SparkSession, root: str, runs: int = MERGED_RUNS) -> None:
    """Size-tiered merging: ``runs`` runs of a level become one of the next, so
    their number grows with the logarithm of the batches and an id is rewritten
    as seldom. Ids keep the name of their ingest. After a crash between the move
    and the deletions some ids are stored twice, which changes no answer."""
    level, now = 0, id_runs(spark, root)
    while len(now.get(level, [])) >= runs:
        rows = spark.read.schema(ID_INDEX).parquet(*now[level])
        _write_run(rows, root, f"{level + 1}-{uuid.uuid4().hex[:16]}")
        for p in now[level]:
            folders.discard(spark, p)
        level, now = level + 1, id_runs(spark, root)


def read_request_ids(spark: SparkSession, root: str, ids: list[str] | None = None,
                     without: str | None = None) -> DataFrame | None:
    """Stored request ids, without those of one ingest (its replay replaces
    them); None if none were ever stored. With ``ids`` only those: row groups
    whose range or Bloom filter excludes all of them are not read. A folder
    that exists but cannot be read is an error."""
    path = f"{root.rstrip('/')}/_request_ids"
    if not id_runs(spark, root):
        return None
    stored = spark.read.schema(ID_INDEX).parquet(path)
    if ids is not None:
        stored = stored.where(F.col("aws_request_id").isin(ids))
    if without is not None:
        stored = stored.where(F.col("ingest") != without)
    return stored.select("aws_request_id")
