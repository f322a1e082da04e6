"""Member roster CSV files.

Header cells are trimmed and matched case-insensitively (name, email, role,
status, seat tier, billing model); blank lines are skipped; cells are
trimmed; commas split naively (no quoting); rows without an email are
skipped; a file without an Email column is an error. Each file is read
whole (one task per file) because the merge needs its line order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


HEADERS = {"name": "name", "email": "email", "role": "role", "status": "status",
           "seat tier": "seat_tier", "billing model": "billing_model_raw"}


def read_roster_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) for every line of the CSV files under ``path``."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def _js_trim(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _cells(c):
    """``line.split(",").map(c => c.trim())`` without a lambda."""
    return F.split(_js_trim(c), r"\s*,\s*")


def parse_roster_lines(lines: DataFrame) -> DataFrame:
    """Lines (file, line, value) -> rows (file, line, email, name, role,
    status, seat_tier, billing_model_raw); ``line`` keeps file order."""
    nonblank = lines.filter(_js_trim(F.col("value")) != "")
    headers = nonblank.groupBy("file").agg(F.min_by("value", "line").alias("_h"), F.min("line").alias("_hline"))
    headers = headers.select(F.col("file").alias("_hfile"), "_hline", _cells(F.lower("_h")).alias("_cols"))
    j = nonblank.join(headers, F.col("file") == F.col("_hfile"))
    pos = {k: F.array_position("_cols", k) for k in HEADERS}
    body = j.filter(F.col("line") > F.col("_hline")).withColumn("_cells", _cells(F.col("value")))

    def cell(k):
        return F.when(pos[k] > 0, F.try_element_at("_cells", pos[k].cast("int")))

    out = body.select(
        "file", "line",
        F.when(pos["email"] == 0, F.raise_error(F.lit("roster file without an email column"))).otherwise(cell("email"))
        .alias("email"),
        *[F.nullif(cell(k), F.lit("")).alias(v) for k, v in HEADERS.items() if k not in ("email", "billing model")],
        cell("billing model").alias("billing_model_raw"),
    )
    return out.filter(F.col("email").isNotNull() & (F.col("email") != ""))


def read_roster_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_roster_lines(read_roster_lines(spark, path))
