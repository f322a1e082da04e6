"""SimHash near-duplicates with pivot distance tables.

Every text gets a 64-bit SimHash of its word shingles. Equal fingerprints are
collapsed first, so a group of copies costs one row. For each distinct
fingerprint the Hamming distances to ``PIVOTS`` reference fingerprints are
computed once (its row of the pivot table). By the triangle inequality two
fingerprints within d bits differ by at most d in *every* coordinate, so pairs
are dropped by their largest coordinate difference and only the survivors are
verified bit by bit.

Pairs are only formed between fingerprints that agree on two of d + 2 bit
blocks (d differing bits leave at least two blocks untouched): an equi-join,
exact for every d, without a cross join and without comparing all members of a
group of copies.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import col, fresh, stored
from usagelens.llm.components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
PIVOTS = 24
# Shingle hashes turned into bit counts at a time: bounds the memory of a long text.
_STEP = 1 << 16


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text; no words (or null): 0."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    ones = np.zeros(64, dtype=np.int64)
    total = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    for lo in range(0, total, _STEP):
        hi = min(total, lo + _STEP)
        h = np.array([digest(line[a:b], SEED) for a, b in
                      zip(starts[lo:hi].tolist(), ends[lo + k - 1:hi + k - 1].tolist())], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed bigint column."""
    @F.pandas_udf("bigint")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return bits(text)


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: n fixed pseudo-random 64-bit values (signed)."""
    values = [xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(n)]
    return [v - (1 << 64) if v >= 1 << 63 else v for v in values]


def pivot_table(prints: DataFrame, n: int = PIVOTS) -> DataFrame:
    """``prints`` (fp) with its coordinates: the distances to the pivots, eight
    bits each, packed into ceil(n / 8) bigint columns p0, p1, ..."""
    packed = []
    for w, lo in enumerate(range(0, n, 8)):
        word = F.lit(0).cast("bigint")
        for i, p in enumerate(pivots(n)[lo:lo + 8]):
            word = word.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("bigint"), 8 * i))
        packed.append(word.alias(f"p{w}"))
    return prints.select("fp", *packed)


def _blocks(d: int) -> list[tuple[int, int]]:
    """(offset, width) of d + 2 bit blocks covering the 64 bits."""
    edges = [round(i * 64 / (d + 2)) for i in range(d + 3)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(prints: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS) -> DataFrame:
    """(u, v), u > v, for all distinct fingerprints within ``max_bits`` bits."""
    if not 0 <= max_bits <= 62:
        raise ValueError("max_bits must lie between 0 and 62")
    words = [f"p{w}" for w in range((n_pivots + 7) // 8)]
    blocks = [F.shiftrightunsigned("fp", off).bitwiseAND(F.lit((1 << width) - 1)) for off, width in _blocks(max_bits)]
    keys = F.array(*[F.struct(F.lit(i).alias("combo"), F.xxhash64(blocks[a], blocks[b]).alias("block"))
                     for i, (a, b) in enumerate(combinations(range(len(blocks)), 2))])
    rows = pivot_table(prints, n_pivots).select("fp", *words, F.explode(keys).alias("k")).select("k.*", "fp", *words)
    a, b = rows.alias("a"), rows.alias("b")
    near = F.lit(True)
    for i in range(n_pivots):
        x, y = (F.shiftright(F.col(f"{s}.p{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(255)) for s in "ab")
        near = near & (F.abs(x - y) <= max_bits)
    verified = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    return (a.join(b, (F.col("a.combo") == F.col("b.combo")) & (F.col("a.block") == F.col("b.block"))
                   & (F.col("a.fp") > F.col("b.fp")) & near & verified)
            .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct())


def _grouped(prints: DataFrame, order: Column, max_bits: int) -> DataFrame:
    """(fp, best): the smallest ``order`` value of the component of each fingerprint.
    ``prints`` has one row per text."""
    classes = stored(prints.groupBy("fp").agg(F.min(order).alias("best")), "prints")
    roots = stored(components(links(classes.select("fp"), max_bits)), "roots")
    linked = classes.join(roots, classes.fp == roots.node).select("fp", "root", "best")
    low = linked.groupBy("root").agg(F.min("best").alias("low"))
    merged = linked.join(low, "root").select("fp", F.col("low").alias("best"))
    return classes.join(merged.select("fp"), "fp", "left_anti").union(merged)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id).

    fingerprint: 16 hex digits; component_id: smallest id reachable over links
    of at most ``max_bits`` bits. Null, empty and blank texts have fingerprint
    zero and link like any other. Repeated rows come back as often as they
    occur; null ids stay null and never name a component (null only if the
    whole component has no id). Other columns are ignored. An empty table
    gives an empty result."""
    prints = stored(docs.select(col(docs, id_col).alias("id"), fingerprint(col(docs, text_col), shingle).alias("fp")),
                    "simhash")
    best = _grouped(prints, F.col("id"), max_bits)
    return prints.join(best, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best").alias("component_id"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with
    the smallest id (rows without id last, then any one of equal rows). Columns
    are unchanged, whatever they are called."""
    fp, row = fresh(docs, "simhash_fp"), fresh(docs, "simhash_row")
    kept = stored(docs.withColumn(fp, fingerprint(col(docs, text_col), shingle))
                  .withColumn(row, F.monotonically_increasing_id()), "simhash")
    rank = F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")
    prints = kept.select(col(kept, id_col).alias("id"), col(kept, fp).alias("fp"), col(kept, row).alias("row"))
    best = _grouped(prints, rank, max_bits).select(F.col("best.row").alias("best_row")).distinct()
    return kept.join(best, col(kept, row) == best.best_row, "left_semi").select(*[col(kept, c) for c in docs.columns])
