"""Spelling variants by dense prefix-suffix tiles.

Two words are near if one inserted, deleted or replaced code point turns one
into the other, that is, if their common prefix and common suffix together
reach the longer length minus one. The single edit lies in the first or in the
last half, so with s the shorter length, near words share their first
floor(s/2) or their last ceil(s/2) code points. Words are dealt into tiles by
(s, side, shared half). A tile is compared densely: its words are rows of
padded code-point matrices (left- and right-aligned), blocks of rows are
compared pair by pair, and prefix plus suffix length decides. Tiles beyond
``BLOCK`` words are cut into blocks, and each pair of blocks is a piece of work
of its own, so no tile has to fit into one task. A pair has one s, and the
suffix tile leaves it to the prefix tile where that has it: nothing is found
twice. Only near pairs leave a tile.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import col, stored

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, SLIP_EVERY = 6, 5, 199
RATIO = 5
BLOCK = 512
# Matrix cells compared at a time; words beyond WIDE code points are compared one pair at a time.
_CELLS, _WIDE = 1 << 22, 2048
# Distinct words counted in a task before they are handed on.
_HELD = 1 << 17


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                 min_count: int = MIN_COUNT, slip_every: int = SLIP_EVERY) -> DataFrame:
    """(word, n): runs of letters in lower case (A-Z only) with their number of
    occurrences. Where ``slip_every`` divides h, the crc32 of "id:run", the run
    loses its code point h % length. Null texts have no words; a null id is
    written as nothing. Words are counted in every task before the shuffle."""
    if min_length < 1:
        raise ValueError("min_length must be positive")
    least = re.compile(RUN[:-1] + "{%d,}" % min_length)

    def run(batches):
        held = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for found, n in Counter(least.findall(text or "")).items():
                    raw = found.encode().lower()
                    h = zlib.crc32(raw, start)
                    if h % slip_every:
                        held[raw] += n
                    elif len(found) > min_length:
                        at = h % len(found)
                        run_ = raw.decode()
                        held[(run_[:at] + run_[at + 1:]).encode()] += n
                if len(held) >= _HELD:
                    yield _counts(held)
                    held = Counter()
        yield _counts(held)

    ids = col(docs, id_col).cast("string").alias("id")
    return (docs.select(ids, col(docs, text_col).alias("text")).mapInArrow(run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())],
                                      names=["word", "n"])


def _matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, left- and right-aligned, padded with zeros."""
    left = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    shift = (np.arange(width)[None, :] - (width - lengths)[:, None])
    right = np.where(shift >= 0, np.take_along_axis(left, np.maximum(shift, 0), axis=1), 0)
    return left, right[:, ::-1]


def _common(a: str, b: str) -> int:
    """Length of the common prefix of two long words."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def near_in_tiles(words: list[str], tile: np.ndarray, part: np.ndarray, half: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Row pairs (i, j) that are near. Rows are sorted by ``tile``, then ``part``
    (0 or 1; rows of part 1 are only compared with part 0, and rows of a tile
    without part 1 with each other). ``half``: the shorter length of the tile;
    ``suffix``: whether its words share their ends."""
    m = len(words)
    if m < 2:
        return np.zeros((0, 2), dtype=np.int64)
    lengths = np.fromiter(map(len, words), np.int64, m)
    starts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
    ends = np.append(starts[1:], m)
    split = np.add.reduceat(part == 0, starts) + starts
    group = np.repeat(np.arange(len(starts)), ends - starts)
    row = np.arange(m)
    two = split[group] < ends[group]
    first = np.where(two, split[group], row + 1)
    number = np.where(two & (part == 1), 0, ends[group] - first)
    width = int(lengths.max())
    wide = width > _WIDE
    left, right = (None, None) if wide else _matrices(words, width)
    step = max(1, _CELLS // (1 if wide else width))
    total, found, lo = np.cumsum(number), [], 0
    while lo < m:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + step, side="right")))
        count = number[lo:hi]
        i = np.repeat(row[lo:hi], count)
        j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[lo:hi], count)
        lo = hi
        short = np.minimum(lengths[i], lengths[j])
        fit = (short == half[i]) & (np.abs(lengths[i] - lengths[j]) <= 1)
        i, j, short = i[fit], j[fit], short[fit]
        if not len(i):
            continue
        if wide:
            pre = np.array([_common(words[a], words[b]) for a, b in zip(i, j)])
            post = np.array([_common(words[a][::-1], words[b][::-1]) for a, b in zip(i, j)])
        else:
            pre, post = (np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), width), short)
                         for differs in (left[i] != left[j], right[i] != right[j]))
        near = (pre + post >= np.maximum(lengths[i], lengths[j]) - 1) & ~(suffix[i] & (pre >= half[i] // 2))
        found.append(np.stack([i[near], j[near]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)


def _compare(batches):
    """Sorted rows (s, suffix, half, lo, hi, part, word, n) -> near pairs. The last
    tile of a batch is carried into the next one, so a tile is never cut."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None and rest.num_rows else rows
        keys = _tile_numbers(rows)
        whole = int(np.searchsorted(keys, keys[-1])) if rows.num_rows else 0
        yield _near(rows.slice(0, whole), keys[:whole])
        rest = rows.slice(whole)
    if rest is not None and rest.num_rows:
        yield _near(rest, _tile_numbers(rest))


def _tile_numbers(rows: pa.Table) -> np.ndarray:
    """Ascending numbers of the tiles, in the order of the rows."""
    new = np.zeros(rows.num_rows, dtype=bool)
    for name in ("s", "suffix", "half", "lo", "hi"):
        values = rows[name].combine_chunks().to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def _near(rows: pa.Table, tiles: np.ndarray) -> pa.RecordBatch:
    words, n = rows["word"].to_pylist(), rows["n"].to_numpy()
    at = near_in_tiles(words, tiles, rows["part"].to_numpy(), rows["s"].to_numpy(), rows["suffix"].to_numpy().astype(bool))
    pick = lambda k: pa.array([words[r] for r in at[:, k]], pa.string())
    return pa.RecordBatch.from_arrays([pick(0), pa.array(n[at[:, 0]], pa.int64()), pick(1), pa.array(n[at[:, 1]], pa.int64())],
                                      names=["a", "a_n", "b", "b_n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every near pair of the distinct words (word, n), once."""
    length = F.char_length("word")
    tiles = F.array(*[F.struct(s.alias("s"), F.lit(side).alias("suffix"), half.alias("half"))
                      for s in (length, length - 1)
                      for side, half in ((False, F.substring("word", F.lit(1), F.floor(s / 2).cast("int"))),
                                         (True, F.substring("word", length - F.ceil(s / 2).cast("int") + 1, F.ceil(s / 2).cast("int"))))])
    rows = words.where("word is not null").select("word", "n", F.explode(tiles).alias("k")).select("word", "n", "k.*").where("s >= 0")
    sizes = rows.groupBy("s", "suffix", "half").agg(F.count("*").alias("m"), F.min(F.char_length("word")).alias("low")).where(
        "m > 1 and low = s").select("s", "suffix", "half", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    keys = ["s", "suffix", "half"]
    dealt = (rows.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(*keys, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                     (F.col("block") > F.col("other")).cast("int").alias("part"), "word", "n"))
    order = [*keys, "lo", "hi"]
    return dealt.repartition(*order).sortWithinPartitions(*order, "part").mapInArrow(_compare, "a string, a_n bigint, b string, b_n bigint")


def _roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, root): the end of every word's chain of forms, by pointer doubling.
    Counts grow by a factor along a chain, so it is short and has no cycle."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(max_rounds):
        a, b = now.alias("a"), now.alias("b")
        moved = a.join(b, F.col("a.root") == F.col("b.word"), "left")
        now = stored(moved.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")),
                     "spelling-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")
    raise RuntimeError("chains of forms did not end")


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words (word, n) -> one row per word: (word, form, root, n, n_near, form_n).

    form: the near word of largest n (ties: the smallest in code-point order) if
    that is at least ``ratio`` times the word's own, else null; root: the end of
    the chain of forms, the word itself if it has none; n_near: its near words.
    ``words`` holds each word once; null words and extra columns are ignored.
    An empty table gives an empty result; words of any length are compared
    whole. ``ratio`` must be 2 or more, so that chains end."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = stored(words.where("word is not null").select("word", F.col("n").cast("bigint").alias("n")), "spelling-words")
    pairs = stored(near_pairs(words), "spelling-near")
    sides = pairs.select("a", "a_n", "b", "b_n").union(pairs.select("b", "b_n", "a", "a_n")).toDF("word", "n", "near", "near_n")
    best = sides.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    found = stored(best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.rank")).alias("near_n"),
                               (-F.col("best.rank") >= F.col("n") * ratio).alias("holds")), "spelling-forms")
    roots = _roots(found.where("holds").select("word", F.col("near").alias("form")))
    return (words.join(found, "word", "left").join(roots, "word", "left")
            .select("word", F.when(F.col("holds"), F.col("near")).alias("form"), F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("holds"), F.col("near_n")).alias("form_n")))
