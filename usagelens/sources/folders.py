"""Folders as units of storage: a result is written aside and moved to its place
in one rename, and a folder that is no longer wanted is first renamed out of
sight (names that begin with ``_`` are not read), then deleted. A crash leaves
either the old or the new state. Needs a file system whose renames are atomic
(HDFS and local ones are)."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the visible folders that match a glob pattern of ``key=value``
    names, sorted. One call to the JVM brings all of them."""
    hpath, fs = _at(spark, pattern)
    text = spark.sparkContext._jvm.org.apache.spark.deploy.SparkHadoopUtil.get().globPath(fs, hpath).mkString("\n")
    return sorted(p for p in text.split("\n") if p and p.rsplit("/", 1)[1][0] not in "_.")


def value(path: str, key: str) -> str | None:
    """The value of ``key=value`` in a path; None for a null partition."""
    text = next(part[len(key) + 1:] for part in path.split("/") if part.startswith(f"{key}="))
    return None if text == "__HIVE_DEFAULT_PARTITION__" else unquote(text)


def aside(path: str) -> str:
    """A fresh hidden folder below ``path`` to write to."""
    return f"{path.rstrip('/')}/_new-{uuid.uuid4().hex[:12]}"


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; the target must not exist yet."""
    src, fs = _at(spark, source)
    dst, _ = _at(spark, target)
    if fs.exists(dst):
        raise FileExistsError(target)
    fs.mkdirs(dst.getParent())
    if not fs.rename(src, dst):
        raise OSError(f"cannot rename {source} to {target}")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder: out of sight at once, then file by file."""
    src, fs = _at(spark, path)
    if not fs.exists(src):
        return
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(src.getParent(), f"_gone-{uuid.uuid4().hex[:12]}")
    if not fs.rename(src, gone):
        raise OSError(f"cannot rename {path}")
    fs.delete(gone, True)
