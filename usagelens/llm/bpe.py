"""Byte-level BPE encoding and decoding.

``encode_words`` is the declarative form: Spark higher-order functions fold the
ranked merges over the bytes of distinct words, looking ranks up in a literal
rank map (an array of hash buckets, so a look-up does not scan the map).

A corpus has millions of distinct words, so sending every (document, word) pair
to a dictionary and back costs several times the input in shuffle, and the fold
costs some hundred microseconds a word (README has the figures). ``encode``
therefore uses the fold for a bounded dictionary of the most frequent words of all
whole texts, and merges the rare rest by the same rule inside the task that
holds the document. The dictionary only saves work: ids never depend on it.
"""

from __future__ import annotations

import base64
import json
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.common import col

FREQUENT_WORDS = 4_000     # size of the dictionary
FOLDED_CHARS = 64          # longest word the fold takes: its work grows with the square of the length
CACHE_WORDS = 500_000      # words a task remembers before it starts anew
ROWS_OUT = 10_000          # counted words handed on at a time


class Vocabulary:
    """Mergeable ranks (bytes -> id) and the pattern that splits a text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern

    @classmethod
    def load(cls, spark: SparkSession, path: str, pattern: str) -> Vocabulary:
        """From a rank file (base64 token, space, rank per line) on the driver."""
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        return cls({base64.b64decode(t): int(r) for t, r in pairs}, pattern)

    def within(self, words: list[str]) -> Vocabulary:
        """The part of the vocabulary that can occur in ``words`` (their ids stay
        the same): keeps the literal of a bounded dictionary small."""
        pieces = {b[i:j] for b in (w.encode("utf-8") for w in words) for i in range(len(b)) for j in range(i + 1, len(b) + 1)}
        return Vocabulary({t: self.ranks[t] for t in pieces if t in self.ranks}, self.pattern)


def _letters(b: bytes) -> str:
    """Bytes as the characters of the same numbers."""
    return b.decode("latin-1")


def rank_map(vocab: Vocabulary) -> Column:
    """The literal rank map: bucket crc32(token) mod (number of buckets) holds
    (token, rank); there are about as many buckets as tokens."""
    buckets: list[list] = [[] for _ in range(max(1, len(vocab.ranks)))]
    for token, rank in vocab.ranks.items():
        buckets[zlib.crc32(token) % len(buckets)].append({"t": _letters(token), "r": rank})
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<t:string,r:int>>>")


def _rank(ranks: Column, token: Column) -> Column:
    bucket = F.element_at(ranks, (F.crc32(F.encode(token, "ISO-8859-1")) % F.size(ranks) + 1).cast("int"))
    return F.try_element_at(F.transform(F.filter(bucket, lambda e: e["t"] == token), lambda e: e["r"]), F.lit(1))


def encode_words(words: DataFrame, word_col: str, vocab: Vocabulary) -> DataFrame:
    """Distinct non-null ``word_col`` values with their ids (array<int>), by
    higher-order functions only. Words are what the pattern matched; the empty
    word has no ids."""
    ranks = rank_map(vocab)
    rows = words.select(col(words, word_col).alias("word")).where("word is not null").distinct()
    parts = F.filter(F.split(F.decode(F.encode("word", "UTF-8"), "ISO-8859-1"), ""), lambda c: c != "")

    def merge(acc, _):
        pairs = F.transform(F.slice(acc, 1, F.size(acc) - 1), lambda a, i: _rank(ranks, F.concat(a, acc[i + 1])))
        # bind the pair ranks once, then join the first pair of the lowest rank
        step = F.transform(F.array(pairs), lambda r: F.struct(r.alias("r"), F.array_min(r).alias("low")))[0]
        at = F.array_position(step["r"], step["low"]).cast("int")
        joined = F.transform(F.array(at), lambda p: F.when(p.isNull(), acc).otherwise(F.concat(
            F.slice(acc, 1, p - 1), F.array(F.concat(acc[p - 1], acc[p])), F.slice(acc, p + 2, F.size(acc)))))[0]
        return F.when(F.size(acc) < 2, acc).otherwise(joined)

    rows = rows.withColumn("parts", parts)
    steps = F.sequence(F.lit(1), F.greatest(F.size("parts"), F.lit(1)))
    rows = rows.withColumn("merged", F.aggregate(steps, F.col("parts"), merge))
    return rows.select("word", F.transform("merged", lambda t: _rank(ranks, t)).alias("ids"))


def count_words(docs: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """(word, n): the distinct words of all whole texts with their occurrences.
    A task hands on one row per word and ``CACHE_WORDS`` distinct words, so
    what is shuffled follows distinct words, not occurrences."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, seen = regex.compile(pattern).findall, Counter()

        def rows():
            words, counts = list(seen), list(seen.values())
            for i in range(0, len(words), ROWS_OUT):
                yield pd.DataFrame({"word": words[i:i + ROWS_OUT], "n": counts[i:i + ROWS_OUT]})

        for batch in batches:
            for text in batch["text"]:
                seen.update(split(text))
                if len(seen) > CACHE_WORDS:
                    yield from rows()
                    seen.clear()
        yield from rows()

    texts = docs.select(col(docs, text_col).cast("string").alias("text")).where("text <> ''")
    parts = texts.mapInPandas(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, text_col: str, vocab: Vocabulary, n: int = FREQUENT_WORDS) -> dict[str, list[int]]:
    """The ``n`` most frequent words (ties: smallest first) of at most
    ``FOLDED_CHARS`` characters with their ids: counted over all whole texts,
    encoded by ``encode_words``."""
    short = count_words(docs, text_col, vocab.pattern).where(F.char_length("word") <= FOLDED_CHARS)
    top = [r["word"] for r in short.orderBy(F.desc("n"), "word").limit(n).collect()]
    frame = docs.sparkSession.createDataFrame([(w,) for w in top], "word string")
    return {r["word"]: list(r["ids"]) for r in encode_words(frame, "word", vocab.within(top)).collect()}


def _merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id of the joined token."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


_NONE = 1 << 62  # rank of a pair that joins to no token


def _merge_word(ids: list[int], merges: dict[tuple[int, int], int]) -> list[int]:
    """Ranked merges over the byte ids of one word: always the lowest rank,
    leftmost first. A merge changes the ranks of its two neighbours only."""
    if len(ids) > 64:
        return _merge_long(ids, merges)
    get = merges.get
    ranks = [get(p, _NONE) for p in zip(ids, ids[1:])]
    while ranks:
        low = min(ranks)
        if low == _NONE:
            break
        i = ranks.index(low)
        ids[i] = low
        del ids[i + 1], ranks[i]
        if i:
            ranks[i - 1] = get((ids[i - 1], low), _NONE)
        if i < len(ranks):
            ranks[i] = get((low, ids[i + 1]), _NONE)
    return ids


def _merge_long(ids: list[int], merges: dict[tuple[int, int], int]) -> list[int]:
    """The same for long runs (a heap of pairs and a linked list, n log n)."""
    import heapq

    n = len(ids)
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := merges.get((ids[i], ids[i + 1]), _NONE)) < _NONE]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], alive[j], nxt[i] = r, False, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for k in (prv[i], i):
            if k >= 0 and nxt[k] < n and (s := merges.get((ids[k], ids[nxt[k]]), _NONE)) < _NONE:
                heapq.heappush(heap, (s, k, ids[k], ids[nxt[k]]))
    return [x for x, ok in zip(ids, alive) if ok]


class _Words(dict):
    """Packed ids by word; a word that is not there is merged and kept."""

    def __init__(self, ranks, merges, known):
        super().__init__(known)
        self.ranks, self.merges = ranks, merges
        self.single = [ranks[bytes([b])] for b in range(256)]

    def __missing__(self, word: str) -> bytes:
        b = word.encode("utf-8")
        whole = self.ranks.get(b)
        ids = [whole] if whole is not None else _merge_word([self.single[x] for x in b], self.merges)
        packed = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return packed


def encode(text: Column, vocab: Vocabulary, known: dict[str, list[int]] | None = None) -> Column:
    """Token ids of a text as little-endian unsigned 32-bit integers (binary).
    Null counts as empty; the empty text has no ids."""
    ranks, pattern = vocab.ranks, vocab.pattern
    frequent = {w: struct.pack(f"<{len(x)}I", *x) for w, x in (known or {}).items()}

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split, merges = regex.compile(pattern).findall, _merges(ranks)
        words = _Words(ranks, merges, frequent)
        for texts in batches:
            out = []
            for t in texts:
                out.append(b"".join(map(words.__getitem__, split(t))) if t else b"")
                if len(words) > CACHE_WORDS:
                    words = _Words(ranks, merges, frequent)
            yield pd.Series(out, dtype=object)

    return ids(text)


def decode(ids: Column, vocab: Vocabulary) -> Column:
    """The bytes of ids as ``encode`` writes them: the pieces, concatenated."""
    ranks = vocab.ranks

    @F.pandas_udf("binary")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = [b""] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        for batch in batches:
            yield pd.Series([b"".join([table[i] for i in np.frombuffer(b, dtype="<u4").tolist()]) if b is not None else None
                             for b in batch])

    return pieces(ids)


def tokenize(docs: DataFrame, vocab: Vocabulary, known: dict[str, list[int]] | None = None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, token_ids (binary, see ``encode``),
    decoded (binary). Null and empty texts have no tokens and decode to nothing;
    equal rows, null ids and other columns make no difference; an empty table
    gives an empty result."""
    rows = docs.select(col(docs, id_col).alias("doc_id"), encode(col(docs, text_col), vocab, known).alias("token_ids"))
    return rows.select("doc_id", (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"), "token_ids",
                       decode(F.col("token_ids"), vocab).alias("decoded"))
