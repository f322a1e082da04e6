"""The corpus pipeline: documents -> language ID -> near-dedup -> benchmark
decontamination -> redaction -> tokens. Each stage takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``; all but the last keep the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm import bpe, decontam, langid, pii, simhash
from usagelens.llm.common import prepare, stored, table
from usagelens.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language (no letter, or null)."""
    prepare(spark)
    return langid.keep_identified(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    prepare(spark)
    return simhash.simhash_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by tags; n_chars follows the new text."""
    prepare(spark)
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars"))) \
        if "n_chars" in done.columns else done


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian 32-bit ids), ids_sha256, decoded_sha256."""
    prepare(spark)
    vocab = vocabulary(spark)
    rows = bpe.tokenize(docs, vocab, bpe.frequent_words(docs, "text", vocab))
    return rows.select("doc_id", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("pii", redaction), ("byte_bpe", tokens)]

# A kernel machine, fingerprints' components and BPE merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
