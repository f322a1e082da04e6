"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Texts and items are split into words (runs of letters and digits, A-Z lower
cased; every character beyond ASCII belongs to a word). The windows of
``WINDOW`` consecutive item words form the set; an item of fewer words is one
shorter window. Document windows of the same lengths are hashed, looked up in
the broadcast set and every hash hit is verified word by word. DataFrame
functions only.

The set is broadcast only within ``MAX_BROADCAST_BYTES`` (measured first); a
larger benchmark is looked up in several parts, each within that bound, so
nothing is dropped and no shuffle of document windows is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import col, fresh

WINDOW = 10
MAX_BROADCAST_BYTES = 64 << 20
# What separates words, before A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is (``lower`` would change accented letters)."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _grams(words_col: Column, n_words: Column, length: int) -> Column:
    """(pos, len, h) of every run of ``length`` words."""
    starts = F.when(n_words >= length, F.sequence(F.lit(0), n_words - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(
        i.alias("pos"), F.lit(length).alias("len"), F.xxhash64(F.slice(words_col, i + 1, F.lit(length))).alias("h")))


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: (h, len, gram, items)."""
    items = (benchmark.select(col(benchmark, id_col).alias("item"), words(col(benchmark, text_col)).alias("ws"))
             .withColumn("n", F.size("ws")).where("n > 0").withColumn("len", F.least("n", F.lit(window))))
    grams = items.select("item", "len", F.explode(F.expr("transform(sequence(1, n - len + 1), i -> slice(ws, i, len))")).alias("gram"))
    return (grams.groupBy("len", "gram").agg(F.collect_set("item").alias("items"))
            .select(F.xxhash64("gram").alias("h"), "len", "gram", "items"))


def _hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, window: int, bench_id: str, bench_text: str,
          limit: int) -> DataFrame:
    """One row per distinct (id, text): id, key (hash of the text), copies,
    n_words, spans (verified (pos, len) hits, sorted), items."""
    wins = windows(benchmark, bench_id, bench_text, window)
    size = F.lit(64) + F.size("items") * 16
    size = size + F.aggregate("gram", F.lit(0), lambda a, w: a + F.octet_length(w) + 16)
    lengths = sorted(r["len"] for r in wins.select("len").distinct().collect())  # at most `window` values
    parts = max(1, math.ceil((wins.agg(F.sum(size)).first()[0] or 0) / limit))

    text = col(docs, text_col)
    base = docs.select(col(docs, id_col).alias("id"), F.xxhash64(text).alias("key"), words(text).alias("ws"))
    base = base.withColumn("n_words", F.size("ws"))
    found = None
    for part in range(parts):
        grams = [_grams(F.col("ws"), F.col("n_words"), n) for n in lengths]
        if part == 0:
            # Every document brings one mark (pos -1), so the pass that looks up also keeps the clean ones.
            grams.insert(0, F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.xxhash64("id", "key").alias("h"))))
        # inline_outer: the plain one would add a size filter that recomputes the windows below the projection
        rows = base.withColumn("grams", F.concat(*grams)).select("id", "key", "ws", "n_words", F.inline_outer("grams"))
        own = wins if parts == 1 else wins.where(F.pmod("h", F.lit(parts)) == part)
        own = F.broadcast(own.select(F.col("h").alias("wh"), F.col("len").alias("wlen"), "gram", "items"))
        same = (F.col("len") == F.col("wlen")) & (F.slice("ws", F.greatest(F.col("pos"), F.lit(0)) + 1, F.col("len")) == F.col("gram"))
        rows = rows.join(own, F.col("h") == F.col("wh"), "left").where((F.col("pos") < 0) | same)
        rows = rows.select("id", "key", "n_words", "pos", "len", "items")
        found = rows if found is None else found.union(rows)
    hit = F.col("pos") >= 0
    return (found.groupBy("id", "key", "n_words")
            .agg(F.count(F.when(~hit, 1)).alias("copies"),
                 F.collect_set(F.when(hit, F.struct("pos", "len"))).alias("spans"),
                 F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items"))))).alias("items"))
            .withColumn("spans", F.array_sort("spans")))


def _covered(spans: Column) -> Column:
    """Words covered by sorted (pos, len) spans."""
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("bigint").alias("n"))
    step = F.aggregate(spans, zero, lambda a, s: F.struct(
        F.greatest(a["reach"], s["pos"] + s["len"]).alias("reach"),
        (a["n"] + F.greatest(F.lit(0), s["pos"] + s["len"] - F.greatest(a["reach"], s["pos"]))).alias("n")))
    return step["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW, bench_id: str = "item_id", bench_text: str = "text",
                  max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside a window that
    occurs), n_items, items (their ids as sorted strings), contaminated.

    Null and empty texts have no words; equal rows come back as often as they
    occur; null ids are kept; items without words form no window, items without
    id count in n_hit but not in n_items; an empty benchmark gives no hits."""
    hits = _hits(docs, benchmark, id_col, text_col, window, bench_id, bench_text, max_broadcast_bytes)
    return (hits.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
            .select(F.col("id").alias("doc_id"), F.col("n_words").cast("bigint"), _covered(F.col("spans")).alias("n_hit"),
                    F.size("items").cast("bigint").alias("n_items"),
                    F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("items"),
                    (F.size("spans") > 0).alias("contaminated")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", id_col: str = "doc_id",
                  text_col: str = "text", window: int = WINDOW, bench_id: str = "item_id", bench_text: str = "text",
                  max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` (all its columns) without contaminated documents
    (``mode="documents"``) or without their hit words and the separators before
    them (``mode="spans"``). Clean documents stay as they are, nulls included."""
    if mode not in ("documents", "spans"):
        raise ValueError("mode is 'documents' or 'spans'")
    hits = _hits(docs, benchmark, id_col, text_col, window, bench_id, bench_text, max_broadcast_bytes)
    hits = hits.where(F.size("spans") > 0)
    key = fresh(docs, "decontam_key")
    keyed = docs.withColumn(key, F.xxhash64(col(docs, text_col)))
    bad = hits.select(F.col("id").alias("bad_id"), F.col("key").alias("bad_key"), F.col("spans").alias("bad_spans"))
    same = col(keyed, id_col).eqNullSafe(bad.bad_id) & (col(keyed, key) == bad.bad_key)
    if mode == "documents":
        return keyed.join(bad, same, "left_anti").select(*[col(keyed, c) for c in docs.columns])
    text = col(keyed, text_col)
    word = f"[^{SEPARATORS[1:-2]}]+"
    pieces = F.regexp_extract_all(text, F.lit(f"(?:{SEPARATORS})?{word}"), F.lit(0))
    tail = F.regexp_extract(text, f"(?:{SEPARATORS})?$", 0)
    # hit words as one run per span, sorted: a word is dropped if the last span that starts at or before it reaches it
    at = F.flatten(F.transform(bad.bad_spans, lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1)))
    kept = F.filter(pieces, lambda w, i: ~F.array_contains(F.array_distinct(at), i))
    cut = F.when(bad.bad_key.isNull(), text).otherwise(F.concat(F.array_join(kept, ""), tail))
    joined = keyed.join(bad, same, "left")
    return joined.select(*[cut.alias(c) if c == text_col else col(keyed, c) for c in docs.columns])
