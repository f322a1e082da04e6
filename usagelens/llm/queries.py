"""The registered queries of this subpackage: thin wrappers that derive the
result columns from what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm import bm25, bpe, chat, clustering, decontam, htmltext, jaccard, langid, pii, quality, simhash, spelling, sql, warc
from usagelens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@register("op1_simhash_dedup")
def op1(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@register("op4_decontamination")
def op4(spark, sf_dir):
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE["op4_decontamination"] = sql.contamination(decontam.WINDOW)


def _written(spans):
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


@register("op5_pii")
def op5(spark, sf_dir):
    found = pii.find_pii(table(spark, sf_dir, "documents"))

    def count(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{pii.KINDS[k]}")

    counts = [count(k) for k in range(len(pii.KINDS))]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _written(F.col("spans")).alias("spans"))


def vocabulary(spark) -> bpe.Vocabulary:
    """The public vocabulary of op6; only its path is a parameter."""
    import public_tokenizers

    return bpe.Vocabulary.load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op6_byte_bpe")
def op6(spark, sf_dir):
    docs, vocab = table(spark, sf_dir, "documents"), vocabulary(spark)
    rows = bpe.tokenize(docs, vocab, bpe.frequent_words(docs, "text", vocab))
    return rows.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op7_language_id")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


@register("op2_bm25_topk")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where(F.col("doc_id") % 50 == 0))


@register("op3_quality_fm")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@register("op8_chat_rotation")
def op8(spark, sf_dir):
    return chat.rotate(table(spark, sf_dir, "conversations"))


ORACLE["op8_chat_rotation"] = """
WITH m AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, body) AS pos FROM m),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
pieces AS (
  SELECT n.conv_id, p.perspective, n.turn, n.speaker, n.pos, n.body,
         CASE WHEN n.speaker = p.perspective THEN 'assistant' WHEN n.speaker = 'system' THEN 'system' ELSE 'user' END AS chat_role,
         CASE WHEN n.speaker = p.perspective THEN '<|im_start|>assistant' WHEN n.speaker = 'system' THEN '<|im_start|>system'
              ELSE '<|im_start|>user name=' || replace(n.speaker, '<|', '< |') END || chr(10) || n.body || '<|im_end|>' || chr(10) AS rendered
  FROM numbered n JOIN people p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM pieces)
SELECT conv_id, perspective, turn, speaker, chat_role, rendered, start,
       CASE WHEN chat_role = 'assistant' THEN start + 22 END AS mask_start,
       CASE WHEN chat_role = 'assistant' THEN start + 22 + length(body) + 10 END AS mask_end
FROM placed
"""


@register("op9_html_text")
def op9(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


@register("op10_warc_revisits")
def op10(spark, sf_dir):
    return warc.roundtrip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op10_warc_revisits"] = sql.revisits(warc.ALPHABET)


@register("op11_jaccard_groups")
def op11(spark, sf_dir):
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


ORACLE["op11_jaccard_groups"] = sql.JACCARD


@register("op12_spelling_variants")
def op12(spark, sf_dir):
    return spelling.spelling_variants(spelling.corpus_words(table(spark, sf_dir, "documents")))


@register("op13_centroid_clusters")
def op13(spark, sf_dir):
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


ORACLE["op13_centroid_clusters"] = sql.clusters(clustering.DIM, clustering.K, clustering.ROUNDS, clustering.SCALE, clustering.SEED)


@register("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
