"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.session import scratch_path

# Rows handed to a Python worker at a time: bounds its memory when texts are long.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on (runtime SQL confs only)."""
    for key, value in {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS),
                       "spark.sql.session.timeZone": "UTC"}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: cuts the
    lineage, survives lost executors, computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of ``df`` (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def col(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"]


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (the fold of a row)."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))


def small_enough(df: DataFrame, size: Column, limit: int) -> bool:
    """Whether the summed ``size`` of ``df``'s rows stays within ``limit``:
    the check that has to precede any broadcast of a table."""
    total = df.agg(F.sum(size)).first()[0]
    return (total or 0) <= limit
